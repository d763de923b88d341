"""A small hand-made graph."""

from vinculo.catalog import EDGE_TYPES, Graph


def small_graph(spark):
    company = [
        (1, "Stripe", "pays", "Active", "Growth", 900, "Summer 2009", "stripe.txt"), (2, "RazorPay", "pays", "Active", "Early", 15, "Winter 2015", "razorpay.txt"), (3, "Scale AI", "labels", "Active", "Growth", 0, "Summer 2016", "scale.txt"),
        (4, "Deadpool", "swims", "Dead", "Early", 5, "Winter 2015", "dead.txt"), (5, "Stub", None, None, None, None, None, None), (6, "Tiny", "b2b saas", "Active", "Early", 7, "Summer 2023", "tiny.txt"),
    ]
    nodes = {
        "Company": spark.createDataFrame(company, "node_id long, name string, description string, status string, stage string, team_size int, yc_batch string, filename string"),
        "Founder": spark.createDataFrame([(1, "Patrick"), (2, "John"), (3, "Harshil")], "node_id long, name string"),
        "Investor": spark.createDataFrame([(1, "Sequoia"), (2, "Y Combinator"), (3, "Tiger")], "node_id long, name string"),
        "Industry": spark.createDataFrame([(1, "Payments"), (2, "AI"), (3, "Artificial Intelligence"), (4, "B2B"), (5, "SaaS")], "node_id long, name string"),
        "Technology": spark.createDataFrame([(1, "Python"), (2, "ai"), (3, "Ruby")], "node_id long, name string"),
        "Location": spark.createDataFrame([(1, "San Francisco", "USA"), (2, "Bengaluru", "India")], "node_id long, city string, country string"),
        "Batch": spark.createDataFrame([(1, "Summer 2009"), (2, "Winter 2015"), (3, "Summer 2023")], "node_id long, name string"),
        "FundingEvent": spark.createDataFrame([(1, "Series A", 2011, "Stripe", "2M"), (2, "Series B", 2012, "Stripe", "18M"), (3, "Series C", None, "Stripe", None), (4, "Seed", 2015, "RazorPay", "1M")], "node_id long, round string, year int, company string, amount string"),
    }
    pairs = {
        "FOUNDED": [(1, 1), (2, 1), (3, 2), (1, 6)], "CO_FOUNDED_WITH": [(1, 2)], "INVESTED_IN": [(1, 1), (1, 2), (2, 1), (3, 2), (2, 2)], "OPERATES_IN": [(1, 1), (2, 1), (3, 2), (4, 3), (6, 4), (6, 5), (3, 3)],
        "HEADQUARTERED_IN": [(1, 1), (2, 2), (3, 1)], "USES": [(1, 3), (2, 1), (3, 1), (3, 2)], "PART_OF": [(1, 1), (2, 2), (4, 2), (6, 3)], "COMPETES_WITH": [(1, 2), (2, 5)],
    }
    edges = {k: spark.createDataFrame([(i, *p) for i, p in enumerate(ps)], "edge_id long, src long, dst long") for k, ps in pairs.items()}
    edges["ACQUIRED_BY"] = spark.createDataFrame([(0, 4, 1, 2020, "unknown"), (1, 3, 5, 0, "1B")], "edge_id long, src long, dst long, year int, amount string")
    edges["RAISED"] = spark.createDataFrame([(0, 1, 1, "2M"), (1, 1, 2, "18M"), (2, 1, 3, None), (3, 2, 4, "1M")], "edge_id long, src long, dst long, amount string")
    assert set(edges) == set(EDGE_TYPES)
    return Graph(spark, nodes, edges)

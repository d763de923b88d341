import pytest

from tests.graphs import small_graph
from vinculo.plans.lowering import answer
from vinculo.plans.rewrites import cap_results, expand_batches, strip_fences
from vinculo.plans.syntax import parse
from vinculo.plans.tokens import QueryError, masked, string_literals

LABEL = 'CASE WHEN toLower(ind.name) IN ["ai", "artificial intelligence"] THEN "Artificial Intelligence" ELSE ind.name END'


@pytest.fixture(scope="module")
def graph(spark):
    return small_graph(spark)


CASES = [
    ('MATCH (f:Founder)-[:FOUNDED]->(c:Company) WHERE toLower(c.name) = "stripe" RETURN f.name AS founder, c.yc_batch AS batch ORDER BY founder', [("John", "Summer 2009"), ("Patrick", "Summer 2009")]),
    ('MATCH (c:Company)<-[:FOUNDED]-(f:Founder) WHERE toLower(c.name) IN ["stripe", "razorpay"] RETURN c.name AS company, f.name AS founder ORDER BY c.name, founder', [("RazorPay", "Harshil"), ("Stripe", "John"), ("Stripe", "Patrick")]),
    ('MATCH (f:Founder)-[:FOUNDED]->(c:Company)-[:HEADQUARTERED_IN]->(l:Location {country: "India"}) MATCH (c)-[:OPERATES_IN]->(ind:Industry) RETURN f.name AS founder, ind.name AS industry', [("Harshil", "Payments")]),
    (f"MATCH (c:Company)-[:OPERATES_IN]->(ind:Industry) RETURN {LABEL} AS industry, count(DISTINCT c) AS n ORDER BY n DESC, industry", [("Artificial Intelligence", 2), ("Payments", 2), ("B2B", 1), ("SaaS", 1)]),
    ("MATCH (c:Company) RETURN c.status AS status, count(DISTINCT c) AS n ORDER BY status", [("Active", 4), ("Dead", 1), (None, 1)]),
    ("MATCH (c:Company) RETURN c.name AS company ORDER BY c.team_size DESC, c.name LIMIT 2", [("Stub",), ("Stripe",)]),
    ('MATCH (c:Company)-[:OPERATES_IN]->(i) WITH c, collect(toLower(i.name)) AS xs WHERE any(x IN xs WHERE x CONTAINS "b2b") AND any(x IN xs WHERE x = "saas") AND c.team_size > 0 AND c.team_size < 20 RETURN DISTINCT c.name AS company, c.team_size AS size ORDER BY c.team_size', [("Tiny", 7)]),
    ('MATCH (c:Company)-[:OPERATES_IN]->(i) WITH c, collect(toLower(i.name)) AS xs WHERE all(x IN ["b2b", "saas"] WHERE x IN xs) RETURN c.name AS company', [("Tiny",)]),
    ('MATCH (c)-[:OPERATES_IN]->(a), (c)-[:OPERATES_IN]->(b) WHERE a.name = "B2B" RETURN c.name AS company, b.name AS other', [("Tiny", "SaaS")]),
    ("MATCH (c:Company)-[:ACQUIRED_BY]->(x:Company) RETURN c.name AS company, x.name AS by ORDER BY c.yc_batch DESC", [("Deadpool", "Stripe"), ("Scale AI", "Stub")]),
    ("MATCH (f:Founder)-[:FOUNDED]->(c:Company) WITH f, count(DISTINCT c) AS n, collect(DISTINCT c.name) AS cs WHERE n > 1 RETURN f.name AS founder, n, cs", [("Patrick", 2, ["Stripe", "Tiny"])]),
    ("MATCH (c:Company)-[r:RAISED]->(fe:FundingEvent) WHERE toLower(fe.round) CONTAINS 'series' RETURN fe.round AS round, r.amount AS amount ORDER BY fe.year DESC", [("Series C", None), ("Series B", "18M"), ("Series A", "2M")]),
    ("MATCH (c:Company)-[:RAISED]->(fe) WITH c, count(fe) AS rounds WHERE rounds > 2 RETURN c.name AS company, rounds", [("Stripe", 3)]),
    ('MATCH (c:Company) WHERE c.status = "Dead" OPTIONAL MATCH (c)-[:HEADQUARTERED_IN]->(l:Location) OPTIONAL MATCH (c)-[:PART_OF]->(b:Batch) RETURN c.name AS company, l.country AS country, b.name AS batch', [("Deadpool", None, "Winter 2015")]),
    ('MATCH (c:Company) OPTIONAL MATCH (c)-[:USES]->(t:Technology) WHERE t.name = "Python" RETURN c.name AS company, t.name AS technology ORDER BY company LIMIT 3', [("Deadpool", None), ("RazorPay", "Python"), ("Scale AI", "Python")]),
    ("MATCH (c:Company) WHERE c.name = 'nothing' RETURN count(DISTINCT c) AS n", [(0,)]),
    ('MATCH (c:Company)-[:USES]->(t:Technology) RETURN count(DISTINCT CASE WHEN toLower(t.name) = "python" THEN c END) AS python, count(t) AS uses, count(*) AS all', [(2, 4, 4)]),
    ("MATCH (i:Investor)-[:INVESTED_IN]->(a:Company {name: 'Stripe'}), (i)-[:INVESTED_IN]->(b:Company {name: 'RazorPay'}) WHERE toLower(i.name) <> 'y combinator' RETURN i.name AS investor", [("Sequoia",)]),
    ("MATCH (l:Location), (b:Batch) RETURN count(*) AS n", [(6,)]),
    ("MATCH (n) RETURN labels(n)[0] AS type, count(n) AS n ORDER BY type LIMIT 2", [("Batch", 3), ("Company", 6)]),
    ("MATCH (c:Company {name: 'Stripe'})-[r]->(x) RETURN type(r) AS type, labels(x)[0] AS label ORDER BY type, label LIMIT 3", [("COMPETES_WITH", "Company"), ("HEADQUARTERED_IN", "Location"), ("OPERATES_IN", "Industry")]),
    ("MATCH (a:Company {name: 'Stripe'})-[:COMPETES_WITH|ACQUIRED_BY]-(b:Company) RETURN b.name AS other ORDER BY other", [("Deadpool",), ("RazorPay",)]),
    ("MATCH (c:Company) WITH c ORDER BY c.name LIMIT 2 MATCH (c)-[:PART_OF]->(b) RETURN c.name AS company, b.name AS batch ORDER BY company", [("Deadpool", "Winter 2015"), ("RazorPay", "Winter 2015")]),
    ("MATCH (c:Company) WHERE NOT c.status IN ['Active', 'Dead'] OR c.status IS NULL RETURN c.name AS company", [("Stub",)]),
    ("MATCH (c:Company) WHERE c.name STARTS WITH 'S' AND c.name ENDS WITH 'e' RETURN c.name AS company, \"x\" AS note", [("Stripe", "x")]),
    ("MATCH (c:Company) WHERE c.team_size > 0 RETURN avg(c.team_size) AS mean, max(c.team_size) AS most, sum(c.team_size) / count(c) AS whole", [(231.75, 900, 231)]),
    ("MATCH (c:Company) WHERE c.name = $name RETURN c.nothing AS nothing", [(None,)]),
    ("MATCH (c:Company) WHERE c.team_size = 'x' OR c.team_size <> 'x' AND c.name = 'Tiny' RETURN c.name AS company // a comment", [("Tiny",)]),
    ("MATCH (c:Company) /* UNION */ WHERE c.name = 'Tiny' RETURN `c`.name AS `the company`", [("Tiny",)]),
    ("MATCH (f:Founder)-[:FOUNDED]->(c:Company) RETURN collect(DISTINCT c.name)[1..3] AS cs, size(collect(f.name)) AS n", [(["Stripe", "Tiny"], 4)]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_results(graph, i):
    text, want = CASES[i]
    got = [tuple(r) for r in answer(graph, text, {"name": "Stripe"}).collect()]
    assert got == want if "ORDER BY" in text else sorted(got, key=str) == sorted(want, key=str)


def test_whole_nodes(graph):
    r = answer(graph, "MATCH (c:Company) WHERE c.name = 'Tiny' RETURN c").collect()[0]["c"].asDict()
    assert r["name"] == "Tiny" and r["id"] == 6 and r["status"] == "Active"
    assert answer(graph, "MATCH (c:Company)-[:OPERATES_IN]->(i) RETURN DISTINCT c").count() == 5
    assert answer(graph, "MATCH (c:Company)-[:OPERATES_IN]->(i) RETURN c, count(i) AS n").where("c.name = 'Tiny'").collect()[0]["n"] == 2


def test_same_counts_for_both_names(graph):
    ask = 'MATCH (c:Company)-[:{}]->(t) WHERE toLower(t.name) IN ["ai", "artificial intelligence"] RETURN count(DISTINCT c) AS n'
    assert answer(graph, ask.format("USES")).collect()[0][0] == 1 and answer(graph, ask.format("OPERATES_IN")).collect()[0][0] == 2


def test_cap(graph):
    assert answer(graph, "MATCH (c:Company) RETURN c.name AS n", cap=2).count() == 2
    assert answer(graph, "MATCH (c:Company) RETURN c.name AS n LIMIT 1", cap=2).count() == 1


# patterns whose last edges are counted, not listed, with what tells the matches of one apart
COUNTED = [
    ("(c:Company)-[x:OPERATES_IN]->(i:Industry), (d:Company)-[y:OPERATES_IN]->(i)", "i.name", ""),
    ("(c:Company)-[x:OPERATES_IN]->(i:Industry)<-[y:OPERATES_IN]-(d:Company)", "i.name", ""),
    ("(a:Investor)-[x:INVESTED_IN]->(c:Company), (b:Investor)-[y:INVESTED_IN]->(c), (d:Investor)-[z:INVESTED_IN]->(c)", "c.name", ""),
    ("(a:Founder)-[x:FOUNDED]->(c:Company)-[y:HEADQUARTERED_IN]->(l:Location), (c)<-[z:INVESTED_IN]-(b:Investor), (c)-[w:OPERATES_IN]->(i:Industry)", "c.name", "WHERE c.team_size > 1"),
    ("(c:Company)-[x]->(t), (d:Company)-[y:USES]->(t)", "c.name", ""),
    ("(a:Company)-[x:COMPETES_WITH]->(b:Company), (b)-[y:COMPETES_WITH]-(d:Company)", "a.name", ""),
    ("(a:Company)-[x:COMPETES_WITH]-(b:Company), (b)-[y:COMPETES_WITH]-(d:Company), (a)-[z:ACQUIRED_BY]-(e:Company)", "b.name", ""),
]


@pytest.mark.parametrize("i", range(len(COUNTED)))
def test_counted_ends_are_the_listed_matches(graph, i):
    pattern, key, where = COUNTED[i]
    edges = [x for x in "xyzw" if f"[{x}" in pattern]
    listed: dict = {}
    for k, *_ in answer(graph, f"MATCH {pattern} {where} RETURN {key} AS k, {', '.join(f'id({x}) AS {x}1' for x in edges)}").collect():
        listed[k] = listed.get(k, 0) + 1
    counted = answer(graph, f"MATCH {pattern} {where} RETURN {key} AS k, count(*) AS n, count({key}) AS m, count(DISTINCT {key}) AS o")
    assert [(c, t) for c, t in counted.dtypes[1:]] == [("n", "bigint"), ("m", "bigint"), ("o", "bigint")]
    got = [tuple(r) for r in counted.collect()]
    assert len(listed) > 0 and sorted(got, key=str) == sorted(((k, n, n if k is not None else 0, int(k is not None)) for k, n in listed.items()), key=str)
    assert answer(graph, f"MATCH {pattern} {where} RETURN count(*) AS n").collect()[0]["n"] == sum(listed.values())
    assert answer(graph, f"MATCH {pattern} WHERE {key} = 'nobody' RETURN count(*) AS n").collect()[0]["n"] == 0


def test_counted_ends_after_rows_and_beside_bound_nodes(graph):
    ask = "MATCH (c:Company)-[:OPERATES_IN]->(i:Industry) WITH c AS d, i MATCH (d)-[:OPERATES_IN]->(i) RETURN count(*) AS n"
    assert answer(graph, ask).collect()[0]["n"] == 7
    ask = "MATCH (c:Company)-[:OPERATES_IN]->(i:Industry) WITH c, i MATCH (d:Company)-[:OPERATES_IN]->(i) RETURN count(*) AS n"
    assert answer(graph, ask).collect()[0]["n"] == 11


def test_pairs_at_one_place_are_counted_not_listed(spark):
    import threading

    from pyspark.sql import functions as F

    from vinculo.catalog import Graph

    n = 300_000
    company = spark.range(n).select(F.col("id").alias("node_id"))
    place = spark.createDataFrame([(1, "x", "Here")], "node_id long, city string, country string")
    graph = Graph(spark, {"Company": company, "Location": place}, {"HEADQUARTERED_IN": spark.range(n).select(F.col("id").alias("edge_id"), F.col("id").alias("src"), F.lit(1).cast("long").alias("dst"))})
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = answer(graph, "MATCH (c:Company)-[:HEADQUARTERED_IN]->(l:Location), (d:Company)-[:HEADQUARTERED_IN]->(l) RETURN l.country AS country, count(*) AS pairs").collect()
    finally:
        late.cancel()
    assert [tuple(r) for r in got] == [("Here", n * (n - 1))]


@pytest.mark.parametrize("text", [
    "CREATE (c:Company) RETURN c", "MATCH (c) SET c.x = 1 RETURN c", "MATCH (c) DETACH DELETE c", "MATCH (a) RETURN a UNION MATCH (b) RETURN b", "UNWIND [1] AS x RETURN x", "CALL db.labels() RETURN 1", "MATCH (c)-[:USES*1..3]->(t) RETURN c",
    "MATCH (c:Company)", "MATCH (c:Company) RETURN", "MATCH (c:Company RETURN c", "RETURN 1 AS x", "MATCH (c:Company) RETURN c.name AS x, c.status AS x", "MATCH (c:Company) RETURN d.name AS x", "MATCH (c:Company) RETURN foo(c.name) AS x",
    "MATCH (c:Company)-[:NOTHING]->(x) RETURN c", "MATCH (c:Company) WHERE c.name = 'a RETURN c", "MATCH (c:Company) RETURN c.name AS n LIMIT x", "MATCH (c:Company) RETURN DISTINCT c.name AS n ORDER BY c.status", "MATCH (c:Company) WHERE c.name = $missing RETURN c",
])
def test_refusals(graph, text):
    with pytest.raises(QueryError):
        answer(graph, text)


def test_only_needed_columns_and_tables_are_read(spark, tmp_path):
    graph = small_graph(spark)
    graph.write(str(tmp_path))
    from vinculo.catalog import Graph

    read = Graph.read(spark, str(tmp_path))
    plan = answer(read, 'MATCH (c:Company)-[:OPERATES_IN]->(i:Industry) WHERE c.status = "Active" RETURN i.name AS industry, count(DISTINCT c) AS n')._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,Active)" in plan and "description" not in plan and plan.count("FileScan") == 3
    plan = answer(read, "MATCH (c:Company)-[:USES]->(t:Technology) RETURN c.name AS company, count(DISTINCT t) AS n")._jdf.queryExecution().executedPlan().toString()
    assert "Technology" not in plan


def test_masks_and_literals():
    text = "MATCH (c) // it's UNION\nWHERE c.x = 'a \\' UNION' /* UNION */ AND c.`UNION` = \"b\" RETURN c"
    assert "UNION" not in masked(text) and len(masked(text)) == len(text) and masked(text).count("\n") == 1
    assert string_literals("a 'x' b \"y'z\" // 'no'") == ["x", "y'z"]
    assert "UNION" not in masked("RETURN 'open UNION")


def test_rewrites():
    assert expand_batches("Compare W23 with s23 and W09.") == "Compare Winter 2023 with Summer 2023 and Winter 2009."
    assert strip_fences("```cypher\nMATCH (c) RETURN c\n```") == "MATCH (c) RETURN c"
    assert cap_results("MATCH (c) RETURN c.name") == "MATCH (c) RETURN c.name\nLIMIT 50"
    assert cap_results("MATCH (c) RETURN c.name LIMIT 100;") == "MATCH (c) RETURN c.name LIMIT 50"
    assert cap_results("MATCH (c) RETURN c.name LIMIT 7 ; ") == "MATCH (c) RETURN c.name LIMIT 7"
    assert cap_results("MATCH (c) WITH c LIMIT 60 RETURN c.name").endswith("LIMIT 60 RETURN c.name\nLIMIT 50")


def test_parser_keeps_expressions_apart():
    q = parse("MATCH (c) WHERE c.a = 1 OR c.b = 2 AND NOT c.d <> 3 RETURN -c.x * 2 + 1 AS y")
    assert q.clauses[0].where.op == "OR" and q.result.items[0].expr.op == "+"

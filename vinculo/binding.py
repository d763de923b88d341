"""The graph's shape over star-schema tables, so its queries run on any scale of them.

Customers are companies, market segments industries, nations with their regions locations, orders funding events,
suppliers both investors and founders, parts technologies, and the half-year of a customer's first order its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Graph
from .runtime import table


def _pairs(df: DataFrame, src: str, dst: str, *, unique: bool = False) -> DataFrame:
    """Distinct edges; the id packs both ends, which are below 2^31. ``unique`` rows need no shuffle to be so."""
    ends = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    return (ends if unique else ends.distinct()).select((F.col("src") * 2**31 + F.col("dst")).alias("edge_id"), "src", "dst")


def star_graph(spark: SparkSession, d: str) -> Graph:
    """The graph of the tables in a folder; everything is lazy, so a query reads only what it needs."""
    customer, orders, lineitem, supplier, part = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "part"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first"))
    batch = F.concat(F.when(F.month("first") <= 6, "Winter ").otherwise("Summer "), F.year("first").cast("string"))
    joined = first.select("c_custkey", batch.alias("yc_batch"))
    b = F.col("c_acctbal")
    status = F.when(b < 0, "Dead").when(b < 2500, "Acquired").when(b < 7500, "Active").when(b < 9500, "Public")
    stage = F.when(b < 2000, "Early").when(b < 7000, "Growth").otherwise("Public")
    company = customer.join(joined, "c_custkey", "left").select(
        F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), status.alias("status"), stage.alias("stage"),
        F.greatest(F.floor(b), F.lit(0)).cast("int").alias("team_size"), "yc_batch", F.lit(None).cast("string").alias("filename"),
    )
    segment_id = F.xxhash64("c_mktsegment").bitwiseAND(F.lit(2**30 - 1))
    batch_id = F.xxhash64("yc_batch").bitwiseAND(F.lit(2**30 - 1))
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    supply = supplier.select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    shared = lineitem.select("l_orderkey", "l_suppkey").distinct()
    other = shared.select("l_orderkey", F.col("l_suppkey").alias("other"))
    bought = customer.where((b >= 0) & (b < 2500)).select(F.col("c_custkey").alias("src"), (F.floor(F.col("c_custkey") / 10) + 1).alias("dst")).where("src <> dst")
    raised = orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("amount"))
    event = orders.select(F.col("o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("round"), F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("string").alias("company"), F.col("o_totalprice").alias("amount"))
    nodes = {
        "Company": company, "Investor": supply, "Founder": supply, "Technology": part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name")),
        "Industry": customer.select(segment_id.alias("node_id"), F.col("c_mktsegment").alias("name")).distinct(),
        "Location": nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("city"), F.col("r_name").alias("country")),
        "Batch": joined.select(batch_id.alias("node_id"), F.col("yc_batch").alias("name")).distinct(), "FundingEvent": event,
    }
    edges = {
        "OPERATES_IN": _pairs(customer.select("c_custkey", segment_id.alias("i")), "c_custkey", "i", unique=True), "HEADQUARTERED_IN": _pairs(customer, "c_custkey", "c_nationkey", unique=True),
        "PART_OF": _pairs(joined.select("c_custkey", batch_id.alias("b")), "c_custkey", "b", unique=True), "INVESTED_IN": _pairs(lines, "l_suppkey", "o_custkey"), "FOUNDED": _pairs(lines.where("l_linenumber = 1"), "l_suppkey", "o_custkey"),
        "USES": _pairs(lines, "o_custkey", "l_partkey"), "CO_FOUNDED_WITH": _pairs(shared.join(other, "l_orderkey").where("l_suppkey < other"), "l_suppkey", "other"),
        "RAISED": raised, "ACQUIRED_BY": _pairs(bought, "src", "dst", unique=True),
    }
    return Graph(spark, nodes, edges)

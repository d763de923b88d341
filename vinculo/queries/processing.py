"""Queries of the other operators: loading, resolution, text functions, sets and streams; and their SQL where it can say the same."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import answers
from ..catalog import Graph
from ..functions import text as fn
from ..operators import enrichment, mutation, resolution
from ..plans.rewrites import expand_batches_column, strip_fences_column
from ..plans.rules import complaints
from ..runtime import durable, table
from ..sources import loader, propgraph, querylog
from ..streaming.incremental import windowed_counts


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """``filename, content``: a JSON document for each company record, with the categories and places of its company."""
    records = table(spark, d, "company_record").where("filename is not null")
    mentions = table(spark, d, "category_mention").where("company_id is not null and name is not null")
    lists = mentions.groupBy("company_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("label") == "Industry", F.col("name")))).alias("industries"), F.sort_array(F.collect_set(F.when(F.col("label") == "Technology", F.col("name")))).alias("technologies")
    )
    places = table(spark, d, "hq_location").where("company_id is not null").groupBy("company_id").agg(F.sort_array(F.collect_set(F.struct("city", "country"))).alias("locations"))
    company = F.struct("name", "description", "status", "stage", "team_size", "yc_batch").alias("company")
    docs = records.join(lists, "company_id", "left").join(places, "company_id", "left")
    return docs.select("filename", F.to_json(F.struct(company, "industries", "technologies", "locations"), {"ignoreNullFields": "false"}).alias("content"))


def _loaded(spark: SparkSession, d: str) -> Graph:
    return loader.build(durable(loader.parse_documents(documents_of(spark, d))))


def load_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label of the graph that the documents make."""
    return _loaded(spark, d).label_histogram()


def load_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges by type of that graph."""
    return _loaded(spark, d).all_edges().groupBy("type").agg(F.count("*").alias("n"))


def load_summary(spark: SparkSession, d: str) -> DataFrame:
    return loader.run_summary(loader.parse_documents(documents_of(spark, d)))


def load_dangling(spark: SparkSession, d: str) -> DataFrame:
    """How many edges lack an end: none."""
    return mutation.dangling(_loaded(spark, d)).agg(F.count("*").alias("n"))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """One company for each exact name: the record of the last file."""
    rows = table(spark, d, "company_record").where("name is not null").select("name", "filename", "record_id", "team_size")
    return mutation.last_wins(rows, ["name"], [F.coalesce("filename", F.lit("")), F.col("record_id")])


def anti_processed(spark: SparkSession, d: str) -> DataFrame:
    """Files of companies that no finished run has had."""
    files = table(spark, d, "company_record").where("filename is not null").select("filename").distinct()
    manifest = table(spark, d, "input_enriched").where("status is not null").select("filename", "status")
    return loader.unprocessed(files, manifest)


def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "input_enriched").groupBy("status").agg(F.count("*").alias("n"))


def batch_expand(spark: SparkSession, d: str) -> DataFrame:
    """Questions about batches by their short names, spelled out."""
    short = F.concat(F.when(F.col("yc_batch").startswith("Winter"), "w").otherwise("S"), F.substring("yc_batch", -2, 2))
    asked = table(spark, d, "company_record").where("yc_batch rlike '^(Winter|Summer) 20[0-9]{2}$'").select(F.concat(F.lit("Who joined "), short, F.lit("?")).alias("q"))
    return asked.select(expand_batches_column(F.col("q")).alias("question")).groupBy("question").agg(F.count("*").alias("n"))


def category_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by category, both names of artificial intelligence as one."""
    rows = table(spark, d, "category_mention").where("name is not null").select(fn.canonical_category(F.col("name")).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def category_lists(spark: SparkSession, d: str) -> DataFrame:
    """The categories of each company, the first of those that differ only in case."""
    rows = table(spark, d, "category_mention").where("name is not null and company_id is not null").groupBy("company_id").agg(F.sort_array(F.collect_list("name")).alias("categories"))
    return answers.normal_categories(rows).select("company_id", F.size("categories").cast("long").alias("n"))


def file_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "company_record").where("filename is not null").select("filename").distinct()
    return rows.select("filename", loader.file_title(F.col("filename")).alias("title"))


def alternate_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_name").where("label = 'Company' and name is not null").select("name").distinct()
    return rows.select("name", F.array_join(fn.alternate_names(F.col("name")), "|").alias("alternates"))


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(fn.page_url(F.col("n_name")).alias("url"))


def enrich_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are relevant to their company, by language."""
    names = table(spark, d, "company_record").where("name is not null").groupBy("company_id").agg(F.min("name").alias("name"))
    docs = table(spark, d, "documents").select("company_id", "text", "lang").join(names, "company_id")
    return docs.groupBy("lang").agg(F.sum(F.when(enrichment.relevant(F.col("text"), F.col("name")), 1).otherwise(0)).alias("relevant"), F.count("*").alias("n"))


def enrich_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Company records as profiles and the documents that name them as pages: how many got one."""
    records = table(spark, d, "company_record").where("name is not null and filename is not null").groupBy("filename").agg(F.min("name").alias("name"))
    profiles = records.select("filename", F.concat(F.lit("YC Startup Profile: "), "name").alias("text"))
    names = table(spark, d, "company_record").where("name is not null").groupBy("company_id").agg(F.min("name").alias("title"))
    pages = table(spark, d, "documents").where("text is not null and text <> ''").join(names, "company_id").select("title", F.col("text").alias("extract"))
    return enrichment.enrich(profiles, pages).groupBy("status").agg(F.count("*").alias("n"))


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names that are similar, all pairs above the report's bound."""
    pairs = resolution.fuzzy_duplicates(table(spark, d, "part").select(F.col("p_name").alias("name")), 0.85, None)
    return pairs.select("name1", "name2", F.round("similarity", 6).alias("similarity"))


def fuzzy_report(spark: SparkSession, d: str) -> DataFrame:
    """The top of the report of similar names of nodes, for each label."""
    return resolution.duplicate_report(_named_graph(spark, d))


def _named_graph(spark: SparkSession, d: str) -> Graph:
    """Investors, founders and companies by name, and who invested where, from the typed names."""
    names = table(spark, d, "entity_name").where("name is not null").select("node_id", "label", "name").distinct()
    nodes = {label: names.where(F.col("label") == label).groupBy("name").agg(F.min("node_id").alias("node_id")).select("node_id", "name") for label in ("Investor", "Founder", "Company")}
    return Graph(spark, nodes, {})


def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers under other names merged: the edges that stay with each canonical name."""
    supplier, lines = table(spark, d, "supplier"), table(spark, d, "lineitem")
    nodes = supplier.select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    edges = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct().select((F.col("src") * 2**31 + F.col("dst")).alias("edge_id"), "src", "dst")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"))
    graph = Graph(spark, {"Investor": nodes, "Technology": parts}, {"BACKS": edges}, {"BACKS": ("Investor", "Technology")})
    aliases = {f"Supplier#{i:09d}": f"Supplier#{i - 1:09d}" for i in range(2, 21, 2)}
    merged = resolution.apply_aliases(graph, aliases, labels=("Investor",))
    counts = merged.edge("BACKS").groupBy("src").agg(F.count("*").alias("n"))
    return merged.node("Investor").join(counts, F.col("src") == F.col("node_id")).select("name", "n")


def merge_similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Investors and founders left after similar names are merged, by label."""
    merged = resolution.merge_similar(_named_graph(spark, d))
    left = [merged.node(label).agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label in resolution.MERGE_LABELS]
    return left[0].unionByName(left[1])


def log_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log: rows and mean by UTC day."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("log_date"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_duration"))


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A question logged and read back."""
    path = tempfile.mkdtemp(prefix="vinculo-log-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.checkpoint.dir')}/log-{os.getpid()}"
    querylog.append(spark, path, question="Who founded Stripe?", result_count=2, duration=0.5)
    return querylog.daily(spark.read.schema(querylog.SCHEMA).parquet(path)).select("status", "n", "mean_duration")


def locate_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Users' addresses by range: how many fall in each."""
    requests = table(spark, d, "events").select(F.format_string("10.%d.%d.%d", (F.col("user_id") / 65536).cast("int") % 256, (F.col("user_id") / 256).cast("int") % 256, F.col("user_id") % 256).alias("ip_address"))
    base = 10 * 256**3
    ranges = spark.createDataFrame([(base, base + 255, "A", "a", "x", 1.0, 1.0), (base + 256, base + 1023, "B", "b", "y", 2.0, 2.0)], "start long, end long, country string, region string, city string, latitude double, longitude double")
    return querylog.locate(requests, ranges).groupBy("country").agg(F.count("*").alias("n"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(table(spark, d, "events"), window="1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def generic_graph(spark: SparkSession, d: str) -> DataFrame:
    """The property-map graph of nations and regions: its edges by type with what they carry."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    pair = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    null = F.lit(None).cast("string")
    node = lambda i, label: F.struct(i.alias("id"), F.lit(label).alias("label"), null.alias("year_founded"), null.alias("domain_of_work"), F.lit("x").alias("description"), null.alias("team_size"), null.alias("status_or_stage"), F.array(F.struct(F.lit("kind").alias("key"), F.lit(label).alias("value"))).alias("extra_attributes"))
    edge = F.struct(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("IN").alias("relationship"), null.alias("investment_amount"), null.alias("share_price"), F.lit("1").alias("valuation"), null.alias("date_occurred"))
    raw = pair.select(F.concat("n_name", F.lit(".txt")).alias("filename"), F.to_json(F.struct(F.array(node(F.col("n_name"), "Nation"), node(F.col("r_name"), "Region")).alias("nodes"), F.array(edge).alias("edges"))).alias("content"))
    nodes, edges = propgraph.upsert(*propgraph.read_graphs(raw))
    kinds = nodes.select(F.col("id").alias("dst"), F.col("props")["kind"].alias("kind"))
    return edges.join(kinds, "dst").groupBy("dst", "type", "kind").agg(F.count("*").alias("n"), F.max(F.col("props")["valuation"]).alias("valuation"))


def strip_code_fences(spark: SparkSession, d: str) -> DataFrame:
    fenced = table(spark, d, "region").select(F.concat(F.lit("```cypher\n"), "r_name", F.lit("\n```")).alias("t"))
    return fenced.select(strip_fences_column(F.col("t")).alias("text"))


def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("10.0.0."), "n_nationkey", F.lit(":80, 1.2.3.4")).alias("forwarded"))
    return rows.select(fn.client_ip(F.lit(None).cast("string"), F.col("forwarded"), F.lit("9.9.9.9")).alias("ip"))


CASES = [
    ("Which companies use AI?", 'MATCH (c:Company)-[:USES]->(t:Technology) WHERE toLower(t.name) = "ai" RETURN c.name AS company'),
    ("Which companies use AI?", 'MATCH (c:Company)-[:USES]->(t:Technology) WHERE toLower(t.name) IN ["ai", "artificial intelligence"] RETURN c.name AS company'),
    ("How many companies are there?", "MATCH (c:Company) RETURN count(c) AS company_count"),
    ("Who founded Stripe?", 'MATCH (c:Company) WHERE c.name = "Stripe" RETURN c.name AS company'),
    ("Which companies joined W23?", 'MATCH (c:Company) WHERE c.yc_batch = "W23" RETURN c.name AS company'),
    ("Which companies are dead?", 'MATCH (c:Company) WHERE c.status = "Dead" RETURN c.name AS company'),
    ("Anything", "MATCH (c) RETURN c UNION MATCH (d) RETURN d"),
]


def validator_report(spark: SparkSession, d: str) -> DataFrame:
    """The rules that some queries break."""
    rows = [(i, q, rule, text) for i, (q, c) in enumerate(CASES) for rule, text in complaints(q, c) or [("none", "")]]
    return spark.createDataFrame(rows, "case_no int, question string, rule string, complaint string")


def grounded_answer(spark: SparkSession, d: str) -> DataFrame:
    """The listing of a result, and that a text which denies it is replaced by it."""
    rows = [r.asDict() for r in table(spark, d, "region").select(F.col("r_name").alias("name")).orderBy("name").limit(50).collect()]
    denied = answers.compose("Which regions?", rows, write=lambda q, r: "No results were found.")
    return spark.createDataFrame([(answers.listing(rows), denied)], "listing string, answer string")


QUERIES = {
    f.__name__: f
    for f in (
        load_histogram, load_edges, load_summary, load_dangling, upsert_last_wins, anti_processed, status_summary, batch_expand, category_normalise, category_lists, file_titles, alternate_names, page_urls, enrich_relevance, enrich_profiles,
        fuzzy_names, fuzzy_report, alias_resolution, merge_similar_names, log_daily, log_round_trip, locate_addresses, windowed_events, generic_graph, strip_code_fences, client_addresses, validator_report, grounded_answer,
    )
}

_DOCS = """WITH good AS (SELECT * FROM company_record WHERE filename IS NOT NULL AND coalesce(trim(name), '') <> ''),
m AS (SELECT DISTINCT g.name AS company, c.label, c.name FROM good g JOIN category_mention c ON c.company_id = g.company_id WHERE trim(c.name, ' ') <> ''),
l AS (SELECT DISTINCT g.name AS company, CASE WHEN coalesce(trim(h.city, ' '), '') = '' THEN 'Unknown' ELSE h.city END AS city, h.country FROM good g JOIN hq_location h ON h.company_id = g.company_id WHERE trim(h.country, ' ') <> ''),
b AS (SELECT DISTINCT name AS company, yc_batch FROM good WHERE trim(yc_batch) <> '')
"""
# DuckDB's similarity compares bytes: the letters beyond ASCII, fewer than the control characters, are written as those
_SIMILAR = """chars AS (SELECT list(DISTINCT c ORDER BY c) AS cs FROM (SELECT unnest(string_split(lower(name), '')) AS c FROM entity_name) WHERE ord(c) > 127),
n AS (SELECT DISTINCT label, name, list_aggregate(list_transform(string_split(lower(name), ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE chr(CAST(CASE WHEN list_position(cs, c) < 32 THEN list_position(cs, c) ELSE list_position(cs, c) + 33 END AS INTEGER)) END), 'string_agg', '') AS low
  FROM entity_name, chars WHERE name IS NOT NULL),
p AS (SELECT a.label, a.name AS n1, b.name AS n2, jaro_winkler_similarity(a.low, b.low) AS s FROM n a JOIN n b ON a.label = b.label AND a.name < b.name)"""
SQL = {
    "load_histogram": _DOCS + """SELECT 'Company' AS type, count(DISTINCT name) AS count FROM good UNION ALL SELECT 'Industry', count(DISTINCT name) FROM m WHERE label = 'Industry' UNION ALL SELECT 'Technology', count(DISTINCT name) FROM m WHERE label = 'Technology'
      UNION ALL SELECT 'Location', count(*) FROM (SELECT DISTINCT city, country FROM l) UNION ALL SELECT 'Batch', count(DISTINCT yc_batch) FROM b""",
    "load_edges": _DOCS + """SELECT 'OPERATES_IN' AS type, count(*) AS n FROM m WHERE label = 'Industry' UNION ALL SELECT 'USES', count(*) FROM m WHERE label = 'Technology' UNION ALL SELECT 'HEADQUARTERED_IN', count(*) FROM l UNION ALL SELECT 'PART_OF', count(*) FROM b""",
    "load_summary": "SELECT CASE WHEN coalesce(trim(name), '') = '' THEN 'no company name' ELSE 'loaded' END AS status, count(*) AS n FROM company_record WHERE filename IS NOT NULL GROUP BY 1",
    "load_dangling": "SELECT 0 AS n",
    "upsert_last_wins": "SELECT name, filename, record_id, team_size FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY coalesce(filename, '') DESC, record_id DESC) AS k FROM (SELECT DISTINCT name, filename, record_id, team_size FROM company_record WHERE name IS NOT NULL)) WHERE k = 1",
    "anti_processed": "SELECT DISTINCT filename FROM company_record WHERE filename IS NOT NULL AND filename NOT IN (SELECT filename FROM input_enriched WHERE status <> 'failed' AND filename IS NOT NULL)",
    "status_summary": "SELECT status, count(*) AS n FROM input_enriched GROUP BY status",
    "batch_expand": "SELECT 'Who joined ' || yc_batch || '?' AS question, count(*) AS n FROM company_record WHERE regexp_matches(yc_batch, '^(Winter|Summer) 20[0-9]{2}$') GROUP BY 1",
    "category_normalise": "SELECT CASE WHEN lower(name) IN ('ai', 'artificial intelligence') THEN 'Artificial Intelligence' ELSE name END AS category, count(*) AS n FROM category_mention WHERE name IS NOT NULL GROUP BY 1",
    "category_lists": "SELECT company_id, count(DISTINCT lower(CASE WHEN lower(name) IN ('ai', 'artificial intelligence') THEN 'Artificial Intelligence' ELSE name END)) AS n FROM category_mention WHERE name IS NOT NULL AND company_id IS NOT NULL GROUP BY company_id",
    "alternate_names": """SELECT name, concat_ws('|', name || ' startup', name || ' Inc', name || ' Inc.', CASE WHEN stripped <> name THEN stripped END) AS alternates
      FROM (SELECT DISTINCT name, regexp_replace(name, '\\s+(Inc\\.?|LLC|Ltd\\.?|Corp\\.?)$', '', 'i') AS stripped FROM entity_name WHERE label = 'Company' AND name IS NOT NULL)""",
    "page_urls": "SELECT 'https://en.wikipedia.org/wiki/' || replace(n_name, ' ', '_') AS url FROM nation",
    "enrich_relevance": """SELECT lang, CAST(sum(CASE WHEN length(text) >= 300 AND contains(lower(text), lower(name)) THEN 1 ELSE 0 END) AS BIGINT) AS relevant, count(*) AS n
      FROM documents JOIN (SELECT company_id, min(name) AS name FROM company_record WHERE name IS NOT NULL GROUP BY company_id) USING (company_id) GROUP BY lang""",
    "fuzzy_names": """SELECT a.n AS name1, b.n AS name2, round(jaro_winkler_similarity(lower(a.n), lower(b.n)), 6) AS similarity FROM (SELECT DISTINCT p_name AS n FROM part) a JOIN (SELECT DISTINCT p_name AS n FROM part) b ON a.n < b.n
      WHERE jaro_winkler_similarity(lower(a.n), lower(b.n)) > 0.85""",
    "fuzzy_report": f"""WITH {_SIMILAR}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, n1, n2) AS k FROM p WHERE s > 0.85)
      SELECT label, printf('%.2f | %s ↔ %s', s, n1, n2) AS line FROM r WHERE k <= 50""",
    "merge_similar_names": f"""WITH RECURSIVE {_SIMILAR}, links AS (SELECT label, n1 AS a, n2 AS b FROM p WHERE s > 0.92 UNION SELECT label, n2, n1 FROM p WHERE s > 0.92),
groups(label, name, g) USING KEY (label, name) AS (
  SELECT label, name, name FROM n
  UNION
  SELECT g.label, l.b, min(g.g) FROM groups g JOIN links l ON l.label = g.label AND l.a = g.name JOIN recurring.groups r ON r.label = l.label AND r.name = l.b WHERE g.g < r.g GROUP BY g.label, l.b)
SELECT label, count(DISTINCT g) AS n FROM groups WHERE label IN ('Investor', 'Founder') GROUP BY label""",
    "alias_resolution": """SELECT s_name AS name, count(DISTINCT dst) AS n FROM (SELECT CASE WHEN l_suppkey BETWEEN 2 AND 20 AND l_suppkey % 2 = 0 THEN l_suppkey - 1 ELSE l_suppkey END AS src, l_partkey AS dst FROM lineitem) JOIN supplier ON s_suppkey = src GROUP BY s_name""",
    "log_daily": "SELECT strftime(ts, '%Y-%m-%d') AS log_date, event_type AS status, count(*) AS n, round(avg(value), 6) AS mean_duration FROM events GROUP BY 1, 2",
    "log_round_trip": "SELECT 'success' AS status, 1 AS n, 0.5 AS mean_duration",
    "locate_addresses": "SELECT CASE WHEN user_id < 256 THEN 'A' WHEN user_id < 1024 THEN 'B' ELSE '' END AS country, count(*) AS n FROM events GROUP BY 1",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "generic_graph": "SELECT r_name AS dst, 'IN' AS type, 'Region' AS kind, count(*) AS n, '1' AS valuation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "strip_code_fences": "SELECT r_name AS text FROM region",
    "client_addresses": "SELECT '10.0.0.' || n_nationkey AS ip FROM nation",
}

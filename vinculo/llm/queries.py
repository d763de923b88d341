"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe, canonical, components, names, packing, residue, splitting, survivorship


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.fuzzy_groups(table(spark, d, "fuzzy_candidates"))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("label", "group_name").agg(F.count("*").alias("n_names"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.resolve(table(spark, d, "category_mention"), table(spark, d, "hq_location"), table(spark, d, "ref_item"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that no item of the list means: how many per field."""
    return p2_found(spark, d).groupBy("field").agg(F.sum(F.when(F.col("ref_id") == 0, 1).otherwise(0)).alias("n_unmatched"), F.count("*").alias("n_cases"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "input_enriched"), "content_id", "content")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "input_enriched").select("content_id", "content").distinct(), "content_id", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.chosen_records(table(spark, d, "company_record"), table(spark, d, "source_trust"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "company_record"), table(spark, d, "source_trust"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "entity_name"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each node with the smallest node of its entity and the number of nodes it is linked with."""
    return names.classes(table(spark, d, "entity_name"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The documents after encoding and decoding; null texts come back empty."""
    return bpe.decode(p7_ids(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")), "doc_id", "n_tokens")


def p8_slack(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, and the least number that could do."""
    full = p8_containers(spark, d).groupBy("container_id").agg(F.sum("size").alias("tokens"))
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    return full.agg(F.count("*").alias("n_containers"), total.alias("tokens"), F.ceil(total / packing.CAPACITY).alias("least_containers"), F.max("tokens").alias("fullest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that stay."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id").join(residue.residue(docs), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_group_sizes, p2_found, p2_unmatched, p3_found, p3_pieces, p4_found, p4_survivors, p5_found, p5_classes, p7_ids, p7_decoded, p8_containers, p8_slack, p9_found, p9_clean)}

# The stand-ins of the operator, as SQL lists and patterns.
_STAND_INS = ", ".join(f"'{x}'" for x in survivorship.STAND_INS)
_FILLED = f"""
WITH words AS (SELECT DISTINCT company_id, record_id, source, updated_at, description, status, stage, team_size, trim(regexp_replace(lower(description), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM company_record WHERE company_id IS NOT NULL AND record_id IS NOT NULL),
several AS (SELECT company_id FROM words GROUP BY company_id HAVING count(DISTINCT record_id) > 1),
filled AS (
  SELECT company_id, 'description' AS field, record_id, source, updated_at FROM words WHERE w <> '' AND w NOT IN ({_STAND_INS}) AND NOT regexp_matches(w, '{survivorship.STAND_IN_SENTENCE}') AND NOT regexp_matches(trim(description), '^(\\[[^\\]]*\\]|<[^>]*>|\\{{+[^}}]*\\}}+)$')
  UNION ALL SELECT company_id, 'status', record_id, source, updated_at FROM words WHERE lower(trim(status)) IN ('active', 'acquired', 'public', 'dead')
  UNION ALL SELECT company_id, 'stage', record_id, source, updated_at FROM words WHERE lower(trim(stage)) IN ('early', 'growth', 'public')
  UNION ALL SELECT company_id, 'team_size', record_id, source, updated_at FROM words WHERE team_size > 0)
"""

SQL = {
    "p1_found": """
WITH RECURSIVE links AS (
  SELECT label, name1 AS a, name2 AS b FROM fuzzy_candidates WHERE similarity > 0.92 AND trim(name1) <> '' AND trim(name2) <> ''
  UNION SELECT label, name2, name1 FROM fuzzy_candidates WHERE similarity > 0.92 AND trim(name1) <> '' AND trim(name2) <> ''),
groups(label, name, group_name) USING KEY (label, name) AS (
  SELECT label, a, min(least(a, b)) FROM links GROUP BY label, a
  UNION
  SELECT g.label, l.b, min(g.group_name) FROM groups g JOIN links l ON l.label = g.label AND l.a = g.name JOIN recurring.groups r ON r.label = l.label AND r.name = l.b WHERE g.group_name < r.group_name GROUP BY g.label, l.b)
SELECT label, name, group_name FROM groups""",
    "p3_found": "SELECT DISTINCT content_id FROM input_enriched WHERE length(content) > 6000",
    "p4_found": _FILLED + """SELECT company_id, field, record_id FROM (
  SELECT f.company_id, field, record_id, row_number() OVER (PARTITION BY f.company_id, field ORDER BY coalesce(trust, -1) DESC, updated_at DESC NULLS LAST, record_id) AS k
  FROM filled f JOIN several USING (company_id) LEFT JOIN source_trust USING (source)) WHERE k = 1""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

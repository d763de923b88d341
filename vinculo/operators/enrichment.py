"""Enrichment of profile texts with pages of an encyclopedia snapshot, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alternate_names, company_name, page_url

# The least length of a relevant page and what stands between a profile and its page.
MIN_LENGTH = 300
MARKER = "\n\n--- WIKIPEDIA ENRICHMENT ---\nSource: "


def relevant(text: Column, name: Column) -> Column:
    """Whether a page is long enough and names the company, in any case."""
    return F.coalesce((F.length(text) >= MIN_LENGTH) & F.contains(F.lower(text), F.lower(name)), F.lit(False))


def enrich(profiles: DataFrame, pages: DataFrame, search: DataFrame | None = None) -> DataFrame:
    """``filename, text, status`` of each profile (``filename, text``): with the first relevant page appended.

    Names are tried in order: the company's own, then its alternates. ``search`` maps a query text (``query, title``)
    to the title of its best page; without it, a page is found by a title equal to the name in any case. ``pages`` are
    ``title, extract``; of several with one title the longest counts. The status is ``enriched``, ``irrelevant`` if
    pages were found but none fits, else ``not_found``.
    """
    named = profiles.withColumn("name", company_name(F.col("filename"), F.col("text")))
    tries = named.select("filename", "name", F.posexplode(F.concat(F.array("name"), alternate_names(F.col("name")))).alias("pos", "try"))
    found = pages.where("title is not null and coalesce(extract, '') <> ''").groupBy("title").agg(F.max_by("extract", F.struct(F.length("extract"), "extract")).alias("extract"))
    if search is None:
        keyed = found.select(F.lower("title").alias("key"), "title", "extract")
        hits = tries.join(keyed, F.lower("try") == F.col("key"))
    else:
        hits = tries.join(search.select(F.col("query").alias("try"), "title").dropDuplicates(["try"]), "try").join(found, "title")
    fits = relevant(F.col("extract"), F.col("name"))
    best = hits.groupBy("filename").agg(F.min_by(F.when(fits, F.struct("title", "extract")), F.when(fits, F.struct("pos", "title"))).alias("page"))
    joined = profiles.join(best, "filename", "left")
    page = F.col("page")
    added = F.concat("text", F.lit(MARKER), page_url(F.col("page.title")), F.lit("\n\n"), F.col("page.extract"))
    seen = hits.select("filename").distinct().withColumn("seen", F.lit(True))
    status = F.when(page.isNotNull(), "enriched").when(F.col("seen"), "irrelevant").otherwise("not_found")
    return joined.join(seen, "filename", "left").select("filename", F.when(page.isNotNull(), added).otherwise(F.col("text")).alias("text"), status.alias("status"))


def resume(profiles: DataFrame, pages: DataFrame, done: DataFrame, search: DataFrame | None = None) -> DataFrame:
    """``enrich`` for the profiles that an earlier output (``filename``) lacks; the others are ``already_done``, untouched.

    An output table is written whole or not at all, so what is there is finished.
    """
    there = done.select("filename").distinct()
    fresh = enrich(profiles.join(there, "filename", "left_anti"), pages, search)
    return fresh.unionByName(profiles.join(there, "filename", "left_semi").select("filename", "text", F.lit("already_done").alias("status")))


def write_enriched(enriched: DataFrame, path: str) -> None:
    """The enriched texts as a table of ``filename, text`` by status; profiles that were done before aren't written again."""
    enriched.where("status <> 'already_done'").write.mode("append").partitionBy("status").parquet(path)

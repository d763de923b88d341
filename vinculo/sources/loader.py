"""From extraction documents (nested JSON) to the graph, set-based: one explode for each kind of node and edge.

A document is one row ``filename, content``. Decisions where the loading of single documents leaves a choice:
a document whose company has no name is skipped and reported; null lists are empty and null elements are dropped; a
later file (by name) overwrites an earlier one of the same company; companies that are only mentioned have just a
name; a mention clears nothing. Missing years are 0, missing amounts ``unknown``, missing rounds ``Unknown``; places
without a country are dropped and a missing city is ``Unknown``. The amount of a round is on its edge and also on the
funding event. Ids are hashes of the keys, so a reload gives the same ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph
from ..operators.mutation import last_wins

# The structure of an extraction document.
DOCUMENT = (
    "company struct<name:string,description:string,status:string,stage:string,team_size:int,yc_batch:string>, founders array<string>, investors array<string>, industries array<string>, "
    "locations array<struct<city:string,country:string>>, technologies array<string>, acquisitions array<struct<acquirer:string,year:int,amount:string>>, "
    "funding_rounds array<struct<round:string,amount:string,year:int>>, competitors array<string>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``filename, content`` of the ``.txt`` files of a folder, whole; blank ones are left out."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    named = texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("content"))
    return named.where(F.trim("content") != "")


def extract(texts: DataFrame, extractor: Callable[[str, str], dict | str | None]) -> DataFrame:
    """``filename, content``: what an extractor of (text, file title) makes of each whole text, as JSON.

    The extractor runs in Python workers, a batch at a time. Null, an exception and what isn't JSON make the document
    a bad one, whose file is reported as failed.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for title, text in zip(pdf["title"], pdf["content"]):
                try:
                    got = extractor(text, title)
                    out.append(got if got is None or isinstance(got, str) else json.dumps(got))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pdf[["filename"]].assign(content=pd.Series(out, dtype=object, index=pdf.index))

    titled = texts.select("filename", "content", file_title(F.col("filename")).alias("title"))
    return titled.mapInPandas(run, "filename string, content string").select("filename", F.coalesce("content", F.lit("")).alias("content"))


def parse_documents(raw: DataFrame) -> DataFrame:
    """``filename``, the fields of the document, and ``problem``: null, ``bad json`` or ``no company name``.

    A company without a name key is named by its file, as is one whose document has no company at all.
    """
    d = raw.select("filename", F.from_json("content", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), F.col("content"))
    absent = F.get_json_object("content", "$.company.name").isNull() & ~F.coalesce(F.get_json_object("content", "$.company"), F.lit("")).rlike(r'"name"\s*:')
    named = F.when(absent, file_title(F.col("filename"))).otherwise(F.col("d.company.name"))
    bad = F.try_parse_json("content").isNull() | ~F.trim("content").startswith("{")
    problem = F.when(bad, "bad json").when(F.coalesce(F.trim(named), F.lit("")) == "", "no company name")
    default = lambda f, v: F.when(~F.coalesce(F.get_json_object("content", "$.company"), F.lit("{}")).rlike(rf'"{f}"\s*:'), F.lit(v)).otherwise(F.col(f"d.company.{f}"))
    company = F.struct(named.alias("name"), default("description", "").alias("description"), default("status", "Unknown").alias("status"), default("stage", "Unknown").alias("stage"), default("team_size", 0).alias("team_size"), default("yc_batch", "").alias("yc_batch"))
    lists = [F.coalesce(F.col(f"d.{c}"), F.array()).alias(c) for c in ("founders", "investors", "industries", "locations", "technologies", "acquisitions", "funding_rounds", "competitors")]
    return d.select("filename", company.alias("company"), *lists, problem.alias("problem"))


def file_title(filename: Column) -> Column:
    """The name of a file as a title: no ending, blanks for dashes and underscores, capitals after any non-letter."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), "[-_]", " ")
    marked = F.regexp_replace(F.lower(stem), r"(?<![\p{L}])(?=[\p{L}])", "\u0001")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def _id(*parts: Column) -> Column:
    """A stable id of a key; null parts count."""
    return F.xxhash64(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])


def _named(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def build(documents: DataFrame) -> Graph:
    """The graph of parsed documents; those with a problem add nothing."""
    spark = documents.sparkSession
    docs = documents.where("problem is null").select(F.col("company.name").alias("company"), F.col("company").alias("c"), "filename", *[c for c in documents.columns if c not in ("company", "filename", "problem")])
    cid = _id(F.lit("Company"), F.col("company"))

    def linked(column: str) -> DataFrame:
        """``company, pos, x`` of one list of every document."""
        return docs.select("company", "filename", F.posexplode(column).alias("pos", "x"))

    nodes: dict[str, DataFrame] = {}
    edges: dict[str, DataFrame] = {}
    for label, column, kind, out in (("Founder", "founders", "FOUNDED", False), ("Investor", "investors", "INVESTED_IN", False), ("Industry", "industries", "OPERATES_IN", True), ("Technology", "technologies", "USES", True)):
        rows = linked(column).where(_named(F.col("x")))
        nid = _id(F.lit(label), F.col("x"))
        nodes[label] = rows.select(nid.alias("node_id"), F.col("x").alias("name")).distinct()
        ends = rows.select(cid.alias("src"), nid.alias("dst")) if out else rows.select(nid.alias("src"), cid.alias("dst"))
        edges[kind] = _edges(ends, kind)

    ordered = docs.select(F.filter("founders", lambda x: _named(x)).alias("f"))
    pairs = ordered.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.slice("f", F.col("i") + 2, F.greatest(F.size("f") - F.col("i") - 1, F.lit(0)))).alias("b"))
    edges["CO_FOUNDED_WITH"] = _edges(pairs.select(_id(F.lit("Founder"), F.col("a")).alias("src"), _id(F.lit("Founder"), F.col("b")).alias("dst")), "CO_FOUNDED_WITH")

    places = linked("locations").where(_named(F.col("x.country"))).select("company", F.coalesce(F.when(_named(F.col("x.city")), F.col("x.city")), F.lit("Unknown")).alias("city"), F.col("x.country").alias("country"))
    pid = _id(F.lit("Location"), F.col("city"), F.col("country"))
    nodes["Location"] = places.select(pid.alias("node_id"), "city", "country").distinct()
    edges["HEADQUARTERED_IN"] = _edges(places.select(cid.alias("src"), pid.alias("dst")), "HEADQUARTERED_IN")

    batches = docs.where(_named(F.col("c.yc_batch"))).select("company", F.col("c.yc_batch").alias("name"))
    bid = _id(F.lit("Batch"), F.col("name"))
    nodes["Batch"] = batches.select(bid.alias("node_id"), "name").distinct()
    edges["PART_OF"] = _edges(batches.select(cid.alias("src"), bid.alias("dst")), "PART_OF")

    amount = F.coalesce(F.when(_named(F.col("x.amount")), F.col("x.amount")), F.lit("unknown")).alias("amount")
    year = F.coalesce("x.year", F.lit(0)).alias("year")
    bought = linked("acquisitions").where(_named(F.col("x.acquirer")))
    edges["ACQUIRED_BY"] = _edges(bought.select(cid.alias("src"), _id(F.lit("Company"), F.col("x.acquirer")).alias("dst"), year, amount, "filename", "pos"), "ACQUIRED_BY", ["year", "amount"])
    rivals = linked("competitors").where(_named(F.col("x")))
    edges["COMPETES_WITH"] = _edges(rivals.select(cid.alias("src"), _id(F.lit("Company"), F.col("x")).alias("dst")), "COMPETES_WITH")

    rounds = linked("funding_rounds").where("x is not null").select("company", "filename", "pos", F.coalesce(F.when(_named(F.col("x.round")), F.col("x.round")), F.lit("Unknown")).alias("round"), year, amount)
    eid = _id(F.lit("FundingEvent"), F.col("round"), F.col("year"), F.col("company"))
    events = last_wins(rounds.select(eid.alias("node_id"), "round", "year", "company", "amount", "filename", "pos"), ["node_id"], [F.col("filename"), F.col("pos")])
    nodes["FundingEvent"] = events.select("node_id", "round", "year", "company", "amount")
    edges["RAISED"] = _edges(rounds.select(cid.alias("src"), eid.alias("dst"), "amount", "filename", "pos"), "RAISED", ["amount"])

    profiles = docs.select(cid.alias("node_id"), F.col("company").alias("name"), "c.description", "c.status", "c.stage", "c.team_size", "c.yc_batch", "filename")
    profiles = last_wins(profiles, ["node_id"], [F.col("filename")])
    stubs = bought.select(F.col("x.acquirer").alias("name")).union(rivals.select(F.col("x").alias("name"))).distinct().select(_id(F.lit("Company"), F.col("name")).alias("node_id"), "name")
    nodes["Company"] = profiles.unionByName(stubs.join(profiles.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)
    return Graph(spark, nodes, edges)


def _edges(ends: DataFrame, kind: str, properties: list[str] | None = None) -> DataFrame:
    eid = _id(F.lit(kind), F.col("src"), F.col("dst")).alias("edge_id")
    if not properties:
        return ends.select("src", "dst").distinct().select(eid, "src", "dst")
    last = ends.groupBy("src", "dst").agg(F.max_by(F.struct(*properties), F.struct("filename", "pos")).alias("p"))
    return last.select(eid, "src", "dst", *[F.col(f"p.{p}").alias(p) for p in properties])


def run_summary(documents: DataFrame) -> DataFrame:
    """``status, n``: how many documents were loaded and how many had which problem."""
    return documents.groupBy(F.coalesce("problem", F.lit("loaded")).alias("status")).agg(F.count("*").alias("n"))


def unprocessed(files: DataFrame, manifest: DataFrame, *, retry_failed: bool = True) -> DataFrame:
    """The files that no earlier run has finished; failed ones come again unless told otherwise."""
    done = manifest.where("status <> 'failed'") if retry_failed else manifest
    return files.join(done.select("filename").distinct(), "filename", "left_anti")


def append_manifest(statuses: DataFrame, path: str) -> None:
    """Add ``filename, status`` of a run to the manifest table."""
    statuses.select("filename", "status").write.mode("append").parquet(path)

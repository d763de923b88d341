"""The generic property graph: nodes with any label and edges with any type, properties as maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import loader

DOCUMENT = (
    "nodes array<struct<id:string,label:string,year_founded:string,domain_of_work:string,description:string,team_size:string,status_or_stage:string,extra_attributes:array<struct<key:string,value:string>>>>, "
    "edges array<struct<source:string,target:string,relationship:string,investment_amount:string,share_price:string,valuation:string,date_occurred:string>>"
)
NODE_PROPERTIES = ("year_founded", "domain_of_work", "description", "team_size", "status_or_stage")
EDGE_PROPERTIES = ("investment_amount", "share_price", "valuation", "date_occurred")


def entity_id(filename: Column) -> Column:
    """The id of the entity a file is about: its stem in lower case, underscores for blanks."""
    return F.lower(F.replace(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit(" "), F.lit("_")))


def extract(texts: DataFrame, extractor) -> DataFrame:
    """Documents of an extractor of (text, id of the entity the file is about), as in ``loader.extract``.

    Whatever id the extractor gives its first node, the file's entity id takes its place, at the ends of edges too.
    """

    def with_id(text: str, title: str):
        got = extractor(text, title)
        if isinstance(got, dict) and got.get("nodes"):
            old, new = got["nodes"][0].get("id"), title.lower().replace(" ", "_")
            for n in got["nodes"]:
                n["id"] = new if n.get("id") == old else n.get("id")
            for e in got.get("edges") or []:
                e.update({k: new for k in ("source", "target") if e.get(k) == old})
        return got

    return loader.extract(texts, with_id)


def read_graphs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, label, props, filename, pos``, ``src, dst, type, props, filename, pos``) of documents ``filename, content``.

    Null properties are left out; key and value pairs with both filled are laid over the fixed properties. Nodes
    without id or label and edges without an end or a type are dropped.
    """
    docs = raw.select("filename", F.from_json("content", DOCUMENT).alias("d"))
    n = docs.select("filename", F.posexplode("d.nodes").alias("pos", "n")).where("n.id is not null and n.label is not null")
    fixed = F.map_filter(F.create_map(*[x for p in NODE_PROPERTIES for x in (F.lit(p), F.col(f"n.{p}"))]), lambda k, v: v.isNotNull())
    pairs = F.filter(F.coalesce(F.col("n.extra_attributes"), F.array()), lambda a: (F.coalesce(a["key"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != ""))
    nodes = n.select(F.col("n.id").alias("id"), F.col("n.label").alias("label"), _overlay(fixed, _last_of_pairs(pairs)).alias("props"), "filename", "pos")
    e = docs.select("filename", F.posexplode("d.edges").alias("pos", "e")).where("e.source is not null and e.target is not null and e.relationship is not null")
    own = F.map_filter(F.create_map(*[x for p in EDGE_PROPERTIES for x in (F.lit(p), F.col(f"e.{p}"))]), lambda k, v: v.isNotNull())
    return nodes, e.select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.relationship").alias("type"), own.alias("props"), "filename", "pos")


def _last_of_pairs(pairs: Column) -> Column:
    """A map of key and value pairs in which the last value of a key counts."""
    keys = F.array_distinct(F.transform(pairs, lambda a: a["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda a: a["key"] == k), -1)["value"]))


def _overlay(below: Column, above: Column) -> Column:
    """Both maps in one; where both have a key, the value of ``above``."""
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with all its properties; of a property, the last value by file and position."""
    each = rows.select(*keys, "filename", "pos", F.explode_outer("props").alias("k", "v"))
    last = each.groupBy(*keys, "k").agg(F.max_by("v", F.struct("filename", "pos")).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("props"))


def upsert(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, label, props``, ``src, dst, type, props``): later properties are laid over earlier ones.

    An edge needs both ends among the nodes, of whatever label; an id that has two labels is two nodes, and an edge to
    it is two edges.
    """
    merged = _merged(nodes, ["label", "id"]).select("id", "label", "props")
    own = _merged(edges, ["src", "dst", "type"])
    ends = merged.select("id", "label")
    linked = own.join(ends.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    return merged, linked.select("src", "src_label", "dst", "dst_label", "type", "props")

"""Changes of a graph as new tables: upserts, renames, merges and deletions, by keys and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import NODE_KEYS, Graph


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by ``order``. An aggregate with a map-side part, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__best"))
    return best.select(*[F.col(f"`{k}`") for k in keys], *[F.col("__best")[c].alias(c) for c in rest]).select(*rows.columns)


def _new_id(keys: list[str]) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Nodes of ``old`` with those of ``new`` merged by key: known keys get the new properties and keep their id.

    ``new`` has the columns of ``old`` without ``node_id``; of several rows with one key the last by ``order`` counts.
    Rows with a null key part are left out. New nodes get a hash of their key for an id, above all counted
    ones, so it is the same however often and wherever it is worked out.
    """
    order = order or [F.lit(0)]
    valid = new.where(" and ".join(f"`{k}` is not null" for k in keys))
    fresh = last_wins(valid, keys, order)
    props = [c for c in old.columns if c not in ("node_id", *keys)]
    both = old.join(fresh.select(*keys, F.struct(F.lit(1).alias("__there"), *[F.col(p) for p in props]).alias("__new")), keys, "full")
    merged = both.select("node_id", *keys, *[F.when(F.col("__new").isNotNull(), F.col("__new")[p]).otherwise(F.col(p)).alias(p) for p in props])
    known, added = merged.where("node_id is not null"), merged.where("node_id is null").drop("node_id")
    numbered = added.withColumn("node_id", _new_id(keys))
    return known.unionByName(numbered).select(*old.columns)


def get_or_create(old: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of ``old`` and one for each key of ``names`` that it lacks, whose other properties are null."""
    missing = names.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct().join(old.select(*keys), keys, "left_anti")
    added = missing.withColumn("node_id", _new_id(keys))
    return old.unionByName(added, allowMissingColumns=True)


def merge_edges(old: DataFrame, new: DataFrame, *, overwrite: bool = True) -> DataFrame:
    """Edges of ``old`` and ``new``, one for each pair of ends.

    With ``overwrite`` the properties of a new edge replace those of the old one; else an edge that is there stays as
    it is. Of equal ends in one table the one with the largest id counts.
    """
    props = [c for c in old.columns if c not in ("edge_id", "src", "dst")]
    both = old.withColumn("__rank", F.lit(0 if overwrite else 1)).unionByName(new.withColumn("__rank", F.lit(1 if overwrite else 0)), allowMissingColumns=True)
    keep = both.groupBy("src", "dst").agg(F.min_by("edge_id", F.col("__rank") if overwrite else -F.col("__rank")).alias("edge_id"), *[F.max_by(p, F.struct("__rank", "edge_id")).alias(p) for p in props])
    return keep.select("edge_id", "src", "dst", *props)


def rename(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes with the names that ``mapping`` (``from_name, to_name``, unique ``from_name``) gives them."""
    return nodes.join(mapping.select(F.col("from_name").alias("name"), "to_name"), "name", "left").withColumn("name", F.coalesce("to_name", "name")).drop("to_name").select(*nodes.columns)


def redirect(edges: DataFrame, merged: DataFrame, label: str, kind: str, ends: tuple[str, str]) -> DataFrame:
    """Edges with the ends that ``merged`` (``node_id, into``) moves.

    Edges between a node and its duplicate vanish; of edges that become parallel the one that was there before the
    merge stays, else the one with the smallest id.
    """
    moved = edges.withColumn("__moved", F.lit(0))
    for end, own in zip(("src", "dst"), ends):
        if own == label:
            m = merged.select(F.col("node_id").alias(end), F.col("into").alias("__into"))
            moved = moved.join(m, end, "left").withColumn("__moved", F.greatest("__moved", F.when(F.col("__into").isNotNull(), 1).otherwise(0))).withColumn(end, F.coalesce("__into", end)).drop("__into")
    if ends[0] == ends[1] == label:
        moved = moved.where("src <> dst or __moved = 0")
    props = [c for c in edges.columns if c not in ("src", "dst")]
    first = moved.groupBy("src", "dst").agg(F.min_by(F.struct(*props), F.struct("__moved", "edge_id")).alias("e"))
    return first.select(*[F.col("e")[c].alias(c) if c in props else F.col(c) for c in edges.columns])


def merge_nodes(graph: Graph, label: str, merged: DataFrame) -> Graph:
    """The graph with nodes of a label merged: ``merged`` has ``node_id, into``, no ``into`` of which is merged itself.

    The duplicates' edges move, their properties go. Rows that merge a node into itself change nothing.
    """
    merged = merged.where("node_id <> into").dropDuplicates(["node_id"])
    nodes = dict(graph.nodes) | {label: graph.node(label).join(merged.select("node_id"), "node_id", "left_anti")}
    edges = {k: redirect(e, merged, label, k, graph.endpoint_labels(k)) if label in graph.endpoint_labels(k) else e for k, e in graph.edges.items()}
    return Graph(graph.spark, nodes, edges, graph.types)


def detach_delete(graph: Graph, label: str, ids: DataFrame) -> Graph:
    """The graph without the nodes of ``ids`` (``node_id``) and without their edges."""
    ids = ids.select("node_id").distinct()
    nodes = dict(graph.nodes) | {label: graph.node(label).join(ids, "node_id", "left_anti")}
    edges = {}
    for kind, table in graph.edges.items():
        for end, own in zip(("src", "dst"), graph.endpoint_labels(kind)):
            if own == label:
                table = table.join(ids.withColumnRenamed("node_id", end), end, "left_anti")
        edges[kind] = table
    return Graph(graph.spark, nodes, edges, graph.types)


def by_name(graph: Graph, label: str) -> DataFrame:
    """``node_id`` and the key columns of a label."""
    return graph.node(label).select("node_id", *NODE_KEYS[label])


def dangling(graph: Graph) -> DataFrame:
    """``type, edge_id`` of the edges that lack an end; none in a sound graph."""
    out = None
    for kind, table in graph.edges.items():
        for end, own in zip(("src", "dst"), graph.endpoint_labels(kind)):
            lost = table.join(graph.node(own).select(F.col("node_id").alias(end)), end, "left_anti").select(F.lit(kind).alias("type"), "edge_id")
            out = lost if out is None else out.unionByName(lost)
    return out.distinct() if out is not None else graph.spark.createDataFrame([], "type string, edge_id long")



"""Consolidating pairwise matches into groups (problem 1): connected components on a two-dimensional grid.

Vertices are hashed into blocks; an edge belongs to the cell (block of one end, block of the other). In each round

1. every cell runs a union-find over its own edges and gives each of its vertices a representative, the smallest
   vertex of its tree;
2. the representatives that a vertex got along its row and column (at most one for each cell, so a bounded list) are
   exchanged: the smallest becomes its parent, and the others are linked to that parent by new edges.

A vertex that represents nobody leaves the graph with its parent. The rounds end when the representatives agree, so no
edge is left; then the parents are resolved from the last round back to the first. Chains of any length are followed.

A vertex in a third of all edges has them spread over its whole row of cells. Each round is a stored table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, durable, lookup

#: Edges that one cell should hold; sets only the number of cells.
CELL_EDGES = 200_000
FIRST_BLOCKS, MAX_BLOCKS = 4, 128


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the edges and the smallest vertex of its tree, by hooking and pointer jumping over arrays."""
    vertices, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(vertices))
    while True:
        pa_, pb = parent[a], parent[b]
        differ = pa_ != pb
        if not differ.any():
            return vertices, vertices[parent]
        a, b, pa_, pb = a[differ], b[differ], pa_[differ], pb[differ]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def blocks_for(edges: int, least: int = 1) -> int:
    """So many blocks that a cell of the triangular grid holds about CELL_EDGES edges."""
    return max(least, min(MAX_BLOCKS, math.ceil(math.sqrt(2 * edges / CELL_EDGES))))


def _forests(edges: DataFrame, blocks: int) -> DataFrame:
    bu, bv = (F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int") for c in ("u", "v"))
    cell = F.least(bu, bv) * blocks + F.greatest(bu, bv)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vertices, reps = local_forest(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"v": vertices, "rep": reps})

    return edges.select("u", "v", cell.alias("cell")).groupBy("cell").applyInPandas(run, "v long, rep long")


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of the edge table ``u long, v long``: the smallest vertex linked with it.

    Rows with a null end are no edges; an edge from a vertex to itself makes it a group of its own if it has no other.
    Repeated edges count once. No edges give no rows.
    """
    edges = durable(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    first = edges
    gone: list[DataFrame] = []
    n = edges.count()
    while n:
        seen = durable(_forests(edges, blocks_for(n, 1 if gone else FIRST_BLOCKS)).groupBy("v").agg(F.collect_set("rep").alias("reps")).select("v", "reps", F.array_min("reps").alias("p")))
        if edges is not first:
            discard(edges)
        gone.append(durable(seen.where(~F.array_contains("reps", F.col("v"))).select("v", "p")))
        edges = durable(seen.select(F.explode("reps").alias("v"), F.col("p").alias("u")).where("u <> v").distinct())
        discard(seen)
        n = edges.count()
    # a vertex that left in round k has a parent that left later or is a root
    roots = None
    for parents in reversed(gone):
        if roots is None:
            roots = parents.select("v", F.col("p").alias("root"))
        else:
            up = roots.select(F.col("v").alias("p"), F.col("root").alias("up"))
            new = lookup(parents, up, "p").select("v", F.coalesce("up", "p").alias("root"))
            roots = durable(new.unionByName(roots))
    vertices = first.select("u").union(first.select("v")).distinct().toDF("v")
    return vertices.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root")) if roots is not None else vertices.select("v", F.col("v").alias("root"))


def name_groups(pairs: DataFrame, space: str = "label", left: str = "name1", right: str = "name2", *, names=("label", "name", "group_name")) -> DataFrame:
    """The group of each name: names linked within one ``space`` directly or through others, named by the smallest.

    Names are compared byte for byte, and the smallest is by the byte order of UTF-8. Rows with a null space or name
    are no links. Extra columns are ignored.
    """
    links = durable(
        pairs.select(F.col(space).alias("s"), F.col(left).alias("a"), F.col(right).alias("b"))
        .where(F.col("s").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
        .select("s", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    seed = 0
    while True:
        key = lambda c: F.xxhash64(F.lit(seed), F.col("s"), F.col(c))  # noqa: B023, E731
        vertices = durable(links.select("s", F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("v", F.xxhash64(F.lit(seed), "s", "name")))
        if vertices.groupBy("v").count().where("count > 1").isEmpty():
            break
        discard(vertices)  # two names with one hash: take another seed
        seed += 1
    found = components(links.select(key("a").alias("u"), key("b").alias("v")))
    members = durable(vertices.join(found, "v"))
    smallest = members.groupBy("root").agg(F.min("name").alias("smallest"))
    return lookup(members, durable(smallest), "root").select(F.col("s").alias(names[0]), F.col("name").alias(names[1]), F.col("smallest").alias(names[2]))


def fuzzy_groups(candidates: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Groups of the names of fuzzy candidates: a row is a link if both names are filled and it scores above the threshold."""
    filled = lambda c: F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    return name_groups(candidates.where(filled("name1") & filled("name2") & (F.col("similarity") > threshold)))

"""Entity resolution on a graph: known aliases, similar names, and merging without losing a node.

Aliases that point to themselves are dropped and cycles get one fixed canonical name, so nothing is deleted without a
survivor. Similar names come from a lossless candidate join instead of all pairs: names within a Jaro-Winkler bound
share a number of letters that depends on their lengths and common beginning only, so they share one of the rarest
letters of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph
from ..functions.text import jaro_winkler_column
from ..runtime import discard, durable
from .mutation import merge_nodes, rename

# Known other names of investors and companies.
KNOWN_ALIASES = {
    "YC": "Y Combinator",
    "YC Accelerator": "Y Combinator",
    "YC (Y Combinator)": "Y Combinator",
    "YC Startup Accelerator": "Y Combinator",
    "Y-Combinator": "Y Combinator",
    "YCombinator": "Y Combinator",
    "Sequoia": "Sequoia Capital",
    "Sequoia Cap": "Sequoia Capital",
    "a16z": "Andreessen Horowitz",
    "Andreessen-Horowitz": "Andreessen Horowitz",
    "Tiger": "Tiger Global",
    "Tiger Global Management": "Tiger Global",
    "Accel Partners": "Accel",
    "Accel Ventures": "Accel",
    "GV": "Google Ventures",
    "FB": "Facebook",
    "Meta Platforms": "Meta",
    "Alphabet": "Google",
    "GOOG": "Google",
}
ALIAS_LABELS = ("Investor", "Founder", "Company")
MERGE_LABELS = ("Investor", "Founder")
REPORT_ABOVE, MERGE_ABOVE, REPORT_ROWS = 0.85, 0.92, 50
#: Bounds at which a top list is looked for before its own; they set only the work, not the result.
TOP_BOUNDS = (0.99, 0.95)


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """``alias, canonical`` with chains followed; self-aliases are left out and a cycle ends at its longest name."""
    aliases = KNOWN_ALIASES if aliases is None else aliases
    rows = []
    for alias in aliases:
        seen = [alias]
        while seen[-1] in aliases and aliases[seen[-1]] not in seen:
            seen.append(aliases[seen[-1]])
        end = seen[-1]
        if end in aliases:  # a cycle
            ring = seen[seen.index(aliases[end]) :]
            end = max(ring, key=lambda n: (len(n), n))
        if end != alias:
            rows.append((alias, end))
    return spark.createDataFrame(rows, "alias string, canonical string")


def apply_aliases(graph: Graph, aliases: dict[str, str] | None = None, labels=ALIAS_LABELS) -> Graph:
    """Nodes under an alias merged into the canonical node, or renamed where there is none.

    Of several aliases of a canonical name that has no node, the smallest id becomes it and the others are merged.
    """
    table = alias_table(graph.spark, aliases)
    for label in labels:
        if label not in graph.nodes:
            continue
        named = graph.node(label).select("node_id", "name")
        aim = named.join(F.broadcast(table), named["name"] == table["alias"]).select("node_id", "canonical")
        there = named.select(F.col("name").alias("canonical"), F.col("node_id").alias("into")).groupBy("canonical").agg(F.min("into").alias("into"))
        heads = aim.groupBy("canonical").agg(F.min("node_id").alias("head"))
        into = aim.join(there, "canonical", "left").join(heads, "canonical").select("node_id", F.coalesce("into", "head").alias("into"))
        graph = merge_nodes(graph, label, into)
        mapping = table.select(F.col("alias").alias("from_name"), F.col("canonical").alias("to_name"))
        graph.nodes[label] = rename(graph.node(label), F.broadcast(mapping))
    return graph


def candidate_pairs(names: DataFrame, above: float) -> DataFrame:
    """``name1, name2`` (name1 < name2) that may be more similar than ``above``; no pair above it is missing.

    A common beginning of p letters, 4 at most, boosts Jaro by p / 10 of what lacks to 1; so from p a bound j on Jaro
    follows, from that one on the common letters m of two names of lengths a and b: m/a + m/b >= 3 j - 1. Letters are
    numbered when repeated and ordered by rarity; two names that share m of them share one among the first a - m + 1
    and b - m + 1. For each p names are compared that begin with the same p letters; those whose letters as bits differ
    in more than a + b - 2 m can't share m. A bound up to 0.6 asks for no common letter and would make every pair a
    candidate; it is refused.
    """
    asked = [3 * (above - p / 10) / (1 - p / 10) - 1 - 1e-9 for p in range(5)]
    if (above - 0.4) / 0.6 <= 1 / 3:
        raise ValueError("names can only be compared above a similarity of 0.6")
    distinct = names.where("name is not null").select("name").distinct().select("name", F.lower("name").alias("low")).withColumn("n", F.length("low")).where("n > 0")
    letters = F.split("low", "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))
    spelled = distinct.select("name", "low", "n", F.explode(numbered).alias("t"))
    # no more different letters than alphabets have, times how often one repeats
    rarity = spelled.groupBy("t").agg(F.count("*").alias("c"))
    # of 256 places for letters, few share one; what shares one only makes names look nearer
    bits = F.array(*[F.expr(f"bit_xor(if(cast(pmod(xxhash64(t), 256) / 64 as int) = {i}, shiftleft(1L, cast(pmod(xxhash64(t), 64) as int)), 0L))") for i in range(4)])
    ordered = spelled.join(rarity, "t").groupBy("name", "low", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("ts"), bits.alias("bits"))
    lengths = distinct.select(F.col("n").alias("m")).distinct()
    levels = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(ask).alias("ask")) for p, ask in enumerate(asked)])).alias("level")
    sizes = distinct.select("n").distinct().join(lengths, F.expr(f"1.0D / greatest(n, m) * least(n, m) + 1 >= {asked[4]}D")).select("n", "m", levels).select("n", "m", "level.*")
    sizes = sizes.where("1.0D / greatest(n, m) * least(n, m) + 1 >= ask")
    shared = F.greatest(F.ceil(F.col("ask") * F.col("n") * F.col("m") / (F.col("n") + F.col("m"))).cast("int"), F.lit(1))
    wanted = sizes.select("n", "m", "p", (F.col("n") - shared + 1).alias("first"), (F.col("n") + F.col("m") - 2 * shared).alias("apart"))
    probes = ordered.join(F.broadcast(wanted), "n").select("name", "bits", "n", "m", "p", "apart", F.expr("substring(low, 1, p)").alias("start"), F.explode(F.slice("ts", 1, F.greatest(F.col("first"), F.lit(0)))).alias("t"))
    left = probes.select(F.col("name").alias("name1"), F.col("bits").alias("bits1"), "n", "m", "p", "apart", "start", "t")
    right = probes.select(F.col("name").alias("name2"), F.col("bits").alias("bits2"), F.col("m").alias("n"), F.col("n").alias("m"), "p", "start", "t")
    hits = left.join(right, ["t", "n", "m", "p", "start"]).where("name1 < name2").where(" + ".join(f"bit_count(bits1[{i}] ^ bits2[{i}])" for i in range(4)) + " <= apart")
    return hits.select("name1", "name2").distinct()


def fuzzy_duplicates(nodes: DataFrame, above: float = REPORT_ABOVE, limit: int | None = REPORT_ROWS) -> DataFrame:
    """``name1, name2, similarity`` of different names more similar than ``above``, the most similar first.

    The limit makes it the report's top list; ``None`` gives all pairs.
    """
    def all_above(bound: float) -> DataFrame:
        return candidate_pairs(nodes, bound).withColumn("similarity", jaro_winkler_column(F.col("name1"), F.col("name2"))).where(F.col("similarity") > bound)

    if not limit:
        return all_above(above)
    # no pair above a bound is missing, so where the limit is reached above a higher one, that is the top list
    for bound in [*(b for b in TOP_BOUNDS if b > above), above]:
        top = durable(all_above(bound).orderBy(F.desc("similarity"), "name1", "name2").limit(limit))
        if bound == above or top.count() == limit:
            break
    return top.orderBy(F.desc("similarity"), "name1", "name2")


def duplicate_report(graph: Graph, labels=ALIAS_LABELS) -> DataFrame:
    """``label, line`` of the similar names of each label."""
    out = None
    for label in labels:
        line = F.format_string("%.2f | %s ↔ %s", "similarity", "name1", "name2")
        own = fuzzy_duplicates(graph.node(label)).select(F.lit(label).alias("label"), line.alias("line"))
        out = own if out is None else out.unionByName(own)
    return out


def connected(pairs: DataFrame) -> DataFrame:
    """``node, root``: every node of ``a, b`` and the smallest it is linked with, by hooking and pointer jumping.

    Each round every root takes the smallest root beside its tree and paths are halved; rounds grow with the logarithm
    of the longest chain.
    """
    edges = durable(pairs.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    up = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = ends.where("ra <> rb").select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("low")).groupBy("node").agg(F.min("low").alias("low"))
        hooks = durable(hooks)
        if hooks.isEmpty():
            return up
        hooked = durable(up.join(hooks, "node", "left").select("node", F.coalesce(F.least("root", "low"), "root").alias("root")))
        while True:
            jumped = durable(hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            moving = not jumped.where("moved").isEmpty()
            hooked = jumped.select("node", "root")
            if not moving:
                break
        discard(up)
        up = hooked


def merge_similar(graph: Graph, labels=MERGE_LABELS, above: float = MERGE_ABOVE) -> Graph:
    """Nodes of similar names merged; the longest name of a group survives, of equally long ones the smallest."""
    for label in labels:
        if label not in graph.nodes:
            continue
        pairs = fuzzy_duplicates(graph.node(label), above, None).select(F.col("name1").alias("a"), F.col("name2").alias("b"))
        groups = connected(pairs)
        best = groups.groupBy("root").agg(F.min_by("node", F.struct(-F.length("node"), "node")).alias("best"))
        ids = graph.node(label).groupBy("name").agg(F.min("node_id").alias("into"))
        target = groups.join(best, "root").join(ids.withColumnRenamed("name", "best"), "best").select(F.col("node").alias("name"), "into")
        merged = graph.node(label).select("node_id", "name").join(target, "name").select("node_id", "into")
        graph = merge_nodes(graph, label, durable(merged))
    return graph


def deduplicate(graph: Graph, *, auto_merge: bool = False, aliases: dict[str, str] | None = None) -> tuple[Graph, DataFrame]:
    """The graph with known aliases resolved and, if asked, similar names merged; and the report before merging."""
    graph = apply_aliases(graph, aliases)
    report = duplicate_report(graph)
    return (merge_similar(graph) if auto_merge else graph), report

"""Filling fixed-capacity containers (problem 8) by minimum bin slack over the histogram of lengths.

Only lengths matter, and there are no more than the capacity of them, so the plan is made on the histogram, whatever
the number of items: take the longest length left, find by a bitset subset-sum over the lengths left the combination
with it that leaves the least slack, and remove it as often as the counts allow at once. Each step uses up at least
one length or leaves fewer of it than one combination needs, so the plan has a few entries per length.

Items are then numbered within their length (in salted parts, each with its offset, so a length that a third of the
items have is no single task) and take the places that the plan has for their length. An item longer than the capacity
is divided into full containers and a rest; no other is. Items of no length take no container.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable

CAPACITY = 2_048
#: Items numbered by one task; sets only the number of salted parts.
PART_ITEMS = 50_000


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the available lengths that fill the room best, by subset sums kept as bits of an integer.

    Counts are taken in powers of two, so a length with many items costs a few shifts. Of equal fillings the one with
    the longest lengths is found.
    """
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            new = (reach | reach << take * length) & mask
            if new != reach:
                layers.append((length, take, reach))
                reach = new
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            picked[length] = picked.get(length, 0) + take
            total -= take * length
    return sorted(picked.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many containers, their lengths with times) for a histogram of lengths up to the capacity."""
    left = {length: n for length, n in histogram.items() if 0 < length <= capacity and n > 0}
    bins = []
    while left:
        top = max(left)
        left[top] -= 1
        if not left[top]:
            del left[top]
        combination = dict(fullest(left, capacity - top)) if left else {}
        left[top] = left.get(top, 0) + 1
        combination[top] = combination.get(top, 0) + 1
        times = min(left[length] // n for length, n in combination.items())
        for length, n in combination.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins.append((times, sorted(combination.items(), reverse=True)))
    return bins


def divide(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``id_col, piece_no, size``: items above the capacity as full pieces and a rest, the others as they are.

    Null sizes and sizes below 1 give no piece.
    """
    sized = items.where(F.col(size_col) > 0).select(F.col(id_col), F.col(size_col).cast("long").alias("__n"))
    numbers = F.explode(F.sequence(F.lit(0), ((F.col("__n") - 1) / capacity).cast("int")))
    pieces = sized.select(id_col, "__n", numbers.alias("piece_no"))
    return pieces.select(id_col, "piece_no", F.least(F.lit(capacity), F.col("__n") - F.col("piece_no") * capacity).cast("int").alias("size"))


def pack(items: DataFrame, id_col: str, size_col: str, *, capacity: int = CAPACITY) -> DataFrame:
    """``id_col, piece_no, size, container_id`` for every piece; containers are numbered from 0.

    Repeated rows are items of their own. No items, no containers.
    """
    spark = items.sparkSession
    pieces = durable(divide(items, id_col, size_col, capacity))
    total = pieces.count()
    salts = max(1, -(-total // PART_ITEMS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("size", "salt").count()
    # at most capacity lengths, and capacity x salts parts
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    places, base = [], 0
    used: dict[int, int] = {}
    for times, combination in plan(histogram, capacity):
        for length, n in combination:
            first = used.get(length, 0)
            places.append((length, first, first + n * times, n, base))
            used[length] = first + n * times
        base += times
    slots = spark.createDataFrame(places, "size int, first long, after long, per long, base long")
    from pyspark.sql import Window as W

    before = F.sum("count").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = parts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy("size", "salt").orderBy(id_col, "piece_no")) - 1
    numbered = salted.select(id_col, "piece_no", "size", "salt", own.alias("own")).join(offsets, ["size", "salt"])
    numbered = numbered.select(id_col, "piece_no", "size", (F.col("own") + F.col("offset")).alias("at"))
    placed = numbered.join(F.broadcast(slots), (numbered["size"] == slots["size"]) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("after"))).drop(slots["size"])
    return placed.select(id_col, "piece_no", "size", (F.col("base") + F.floor((F.col("at") - F.col("first")) / F.col("per"))).cast("long").alias("container_id"))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinculo.llm import components as C

SCHEMA = "label string, name1 string, name2 string, similarity double"


def expected(links):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for label, a, b in links:
        a, b = find((label, a)), find((label, b))
        if a != b:
            low, high = sorted((a, b), key=lambda n: n[1].encode())
            top[high] = low
    return {(*x, find(x)[1]) for x in list(top)}


def run(spark, rows):
    return {tuple(r) for r in C.fuzzy_groups(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_local_forest_matches_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 40))]
        vertices, reps = C.local_forest(np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
        want = {(v, r) for _, v, r in [(x[0], int(x[1]), int(x[2])) for x in _numbers(edges)]}
        assert set(zip(vertices.tolist(), reps.tolist())) == want


def _numbers(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for u, v in edges:
        u, v = find(u), find(v)
        top[max(u, v)] = min(u, v)
    return [("", x, find(x)) for x in list(top)]


def test_long_chain_and_hub(spark):
    chain = [("A", f"c{i:04d}", f"c{i + 1:04d}", 0.95) for i in range(300)]
    random.Random(2).shuffle(chain)
    hub = [("A", "hub", f"leaf{i}", 0.93) for i in range(300)]
    rows = chain + hub + [("B", "c0000", "other", 0.99)]
    assert run(spark, rows) == expected([r[:3] for r in rows])


def test_random_graphs_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_EDGES", 5)
    rng = random.Random(3)
    rows = [(rng.choice("AB"), f"n{rng.randrange(200)}", f"n{rng.randrange(200)}", 0.95) for _ in range(180)]
    assert run(spark, rows) == expected([r[:3] for r in rows])


def test_nulls_blanks_repeats_and_bound(spark):
    rows = [
        ("A", "x", "y", 0.92), ("A", "x", None, 0.99), ("A", " ", "y", 0.99), (None, "p", "q", 0.99), ("A", "p", "q", None),
        ("A", "s", "s", 0.99), ("A", "u", "v", 0.93), ("A", "v", "u", 0.5), ("A", "u", "v", 0.93), ("A", "É", "e", 0.99), ("A", "e", "z", 0.95),
    ]
    assert run(spark, rows) == {("A", "s", "s"), ("A", "u", "u"), ("A", "v", "u"), ("A", "É", "e"), ("A", "e", "e"), ("A", "z", "e")}


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([("A", "x", "y", 0.95, 1, 2, 3)], SCHEMA + ", v int, root int, cell int")
    assert {tuple(r) for r in C.fuzzy_groups(df).collect()} == {("A", "x", "x"), ("A", "y", "x")}


def test_components_with_null_ends(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (None, 3), (7, 7)], "u long, v long")
    assert {tuple(r) for r in C.components(df).collect()} == {(1, 1), (2, 1), (7, 7)}


@pytest.mark.parametrize("n", [10, 5000])
def test_lookup_with_a_hot_key(spark, n):
    from vinculo.runtime import lookup

    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).cast("long").alias("k"), "id")
    dim = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    rows = lookup(left, dim, "k").collect()
    assert len(rows) == n and all(r["x"] == (None if r["k"] is None else r["k"] * 10) for r in rows)

import random
from collections import Counter
from itertools import product

from vinculo.llm import packing as P


def test_fullest_matches_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(1, 40)
        best = max(t for times in product(*[range(n + 1) for n in counts.values()]) if (t := sum(n * x for n, x in zip(times, counts))) <= room)
        got = P.fullest(counts, room)
        assert sum(x * n for x, n in got) == best and all(n <= counts[x] for x, n in got)


def test_plan_uses_every_item_once():
    rng = random.Random(7)
    histogram = Counter(rng.randrange(1, 101) for _ in range(3000))
    used = Counter()
    bins = P.plan(histogram, 100)
    for times, combination in bins:
        assert sum(x * n for x, n in combination) <= 100
        for x, n in combination:
            used[x] += n * times
    assert used == histogram
    total = sum(x * n for x, n in histogram.items())
    assert sum(t for t, _ in bins) <= 1.01 * total / 100 + 1


def test_table(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ITEMS", 100)
    rng = random.Random(8)
    rows = [(i, rng.choice([7, 7, 7, 30, 55, 100, 101, 250, 0]), 1) for i in range(1500)] + [(5000, None, 1), (5001, -3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n int, container_id int")
    got = P.pack(df, "doc_id", "n", capacity=100).collect()
    sizes = {r[0]: r[1] for r in rows if (r[1] or 0) > 0}
    pieces = Counter()
    bins = Counter()
    for r in got:
        pieces[r["doc_id"]] += r["size"]
        bins[r["container_id"]] += r["size"]
        assert sizes[r["doc_id"]] > 100 or r["piece_no"] == 0
    assert dict(pieces) == sizes
    assert max(bins.values()) <= 100 and set(bins) == set(range(len(bins)))
    assert len({(r["doc_id"], r["piece_no"]) for r in got}) == len(got)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n").count() == 0

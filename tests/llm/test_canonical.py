import datetime as dt

import pytest

from vinculo.llm import canonical as K
from vinculo.llm.strings import SegmentIndex, banded_distance, fold

REF = [
    (1, "industry", "Artificial Intelligence", None, ["AI", "machine intelligence"]), (2, "industry", "Financial Technology", None, ["fintech"]), (3, "industry", "Vertical Farming", None, []), (4, "industry", "Agriculture", None, ["farming"]),
    (5, "technology", "Time Series Database", None, []), (6, "technology", "Graph Database", None, []), (7, "country", "Ostland", None, ["OLD"]), (8, "country", "Westria", None, []),
    (9, "city", "Port Mola", "Ostland", []), (10, "city", "Port Mola", "Westria", []), (11, "city", "North Gari", "Ostland", []), (12, "city", "South Gari", "Ostland", []),
]
NOW = dt.datetime(2024, 1, 1)


def slow_distance(a, b):
    d = {(i, j): max(i, j) if not min(i, j) else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance_and_index_match_brute_force():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
    words = [word() for _ in range(60)]
    index = SegmentIndex([w for w in words if w], K.edits)
    for w in words:
        for x in words:
            d = slow_distance(w, x)
            for k in (0, 1, 2, 3):
                assert banded_distance(w, x, k) == (d if d <= k else k + 1)
        want = {x: slow_distance(w, x) for x in words if x and slow_distance(w, x) <= K.edits(len(x))}
        assert index.search(w) == want


def test_fold():
    assert fold("  ÉÇole​  Straße ") == "ecole strasse"


@pytest.fixture(scope="module")
def resolved(spark):
    mentions = [
        (1, "Industry", "ai"), (2, "Industry", "Artifical Inteligence"), (3, "Industry", "Intelligence, Artificial"), (4, "Industry", "Artificial Intelligence"), (5, "Industry", "Fin tech"), (6, "Industry", "vertical farming"),
        (7, "Industry", "Robot Wrestling"), (8, "Industry", "n/a"), (9, "Industry", None), (10, "Industry", " "), (11, "Technology", "TSD"), (12, "Technology", "Graph DB v2"), (13, "Technology", "Graph Paper"), (14, "Founder", "ai"),
        (15, "Industry", "Financial Tech industry"), (16, "Industry", "x" * 50_000), (1, "Industry", "ai"), (None, "Industry", "ai"),
    ]
    places = [
        (1, "Port Mola", "Ostland"), (2, "port mola", "Westria"), (3, "Port Mola (Westria)", None), (4, "Port Mola", None), (5, "Nort Gari", "ostlnad"), (6, "Gari", "Ostland"), (7, "North Gari", "OLD"), (8, None, "The Westria"),
        (9, "remote", "International"), (10, None, None),
    ]
    m = spark.createDataFrame([(*r, NOW, "x") for r in mentions], "mention_id long, label string, name string, loaded_at timestamp, kind string")
    p = spark.createDataFrame([(*r, "x") for r in places], "location_id long, city string, country string, items string")
    ref = spark.createDataFrame(REF, "ref_id long, kind string, canonical string, country string, aliases array<string>")
    return {(r["field"], r["row_id"]): r["ref_id"] for r in K.resolve(m, p, ref).collect()}


def test_mentions(resolved):
    want = {1: 1, 2: 1, 3: 1, 5: 2, 6: 3, 7: 0, 8: 0, 15: 2, 16: 0}
    assert {k[1]: v for k, v in resolved.items() if k[0] == "industry"} == want
    assert {k[1]: v for k, v in resolved.items() if k[0] == "technology"} == {11: 5, 12: 6, 13: 0}


def test_places(resolved):
    # a city name in two countries is decided by the country; without one nothing decides
    assert {k[1]: v for k, v in resolved.items() if k[0] == "city"} == {1: 9, 2: 10, 3: 10, 4: 0, 5: 11, 6: 0, 9: 0}
    assert {k[1]: v for k, v in resolved.items() if k[0] == "country"} == {5: 7, 7: 7, 8: 8, 9: 0}


def test_empty_tables(spark):
    m = spark.createDataFrame([], "mention_id long, label string, name string")
    p = spark.createDataFrame([], "location_id long, city string, country string")
    ref = spark.createDataFrame(REF, "ref_id long, kind string, canonical string, country string, aliases array<string>")
    assert K.resolve(m, p, ref).count() == 0
    none = spark.createDataFrame([], "ref_id long, kind string, canonical string, country string, aliases array<string>")
    one = spark.createDataFrame([(1, "Industry", "ai")], "mention_id long, label string, name string")
    assert [tuple(r) for r in K.resolve(one, p, none).collect()] == [("industry", 1, 0)]


def test_no_candidate_is_dropped_before_the_country_is_known(spark):
    # nine cities of one beginning; the country decides, also for the first and the last of them, and a tie is none
    names = [f"San {x}" for x in ("Alba", "Bela", "Cora", "Duno", "Evor", "Fira", "Gulo", "Hado", "Ilmo")]
    home = {"San Alba": "Ostland", "San Ilmo": "Westria", "San Bela": "Nordia", "San Hado": "Nordia"}
    ref = [(i, "city", n, home.get(n, "Sudia"), []) for i, n in enumerate(names, 1)] + [(20 + i, "country", n, None, []) for i, n in enumerate(("Ostland", "Westria", "Nordia", "Sudia"))]
    ref = spark.createDataFrame(ref, "ref_id long, kind string, canonical string, country string, aliases array<string>")
    m = spark.createDataFrame([], "mention_id long, label string, name string")
    p = spark.createDataFrame([(1, "San", "Ostland"), (2, "San", "Westria"), (3, "San", "Nordia"), (4, "San", "Sudia"), (5, "San", None), (6, "San (Ostland)", None)], "location_id long, city string, country string")
    assert {r["row_id"]: r["ref_id"] for r in K.resolve(m, p, ref).collect() if r["field"] == "city"} == {1: 1, 2: 9, 3: 0, 4: 0, 5: 0, 6: 1}


def test_candidates_are_those_that_may_decide():
    m = K.Matcher([(i, f"name{i}", []) for i in range(12)])
    assert len(m.rank([("name", [])], "name", True, False)) == 12
    # lifted, the second ties with the first, so it counts though it stays below the threshold
    assert dict(m.candidates([(0.801, "name1"), (0.738, "name2"), (0.73, "name3")])) == {1: 0.801, 2: 0.738}
    assert dict(m.candidates([(1.0, "name1"), (0.937, "name2"), (0.93, "name3")])) == {1: 1.0, 2: 0.937}
    assert m.candidates([]) == [] and m.candidates([(0.7, "name1")]) == []

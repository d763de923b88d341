import itertools
import random

import pytest
from pyspark.sql import functions as F

from vinculo.catalog import Graph
from vinculo.functions import text as fn
from vinculo.operators import mutation, resolution
from vinculo.queries import processing


def graph_of(spark, names, edges=()):
    nodes = spark.createDataFrame(list(enumerate(names)), "node_id long, name string")
    companies = spark.createDataFrame([(0, "A"), (1, "B")], "node_id long, name string")
    links = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "edge_id long, src long, dst long")
    return Graph(spark, {"Investor": nodes, "Company": companies}, {"INVESTED_IN": links})


def test_jaro_winkler_matches_another_implementation():
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))) for _ in range(80)] + ["martha", "marhta", "dixon", "dicksonx"]
    con = duckdb.connect()
    for a, b in itertools.islice(itertools.combinations(words, 2), 1500):
        assert fn.jaro_winkler(a, b) == pytest.approx(con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-9)
    assert fn.jaro_winkler("", "") == 1 and fn.jaro_winkler("a", "") == 0


@pytest.mark.parametrize("above", [0.85, 0.92, 0.65])
def test_candidates_lose_no_pair(spark, above):
    rng = random.Random(5)
    names = list({"".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 10))) for _ in range(120)}) + ["Anna", "anna", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["name1"], r["name2"]) for r in resolution.fuzzy_duplicates(df, above, None).collect()}
    real = sorted(n for n in names if n)
    assert got == {(a, b) for a, b in itertools.combinations(real, 2) if fn.jaro_winkler(a.lower(), b.lower()) > above}


def test_bounds_that_spare_no_pair_are_refused(spark):
    with pytest.raises(ValueError):
        resolution.fuzzy_duplicates(spark.createDataFrame([("a",)], "name string"), 0.5)


def test_report_is_ordered_and_limited(spark):
    df = spark.createDataFrame([(f"Fund {i:03d}",) for i in range(30)], "name string")
    rows = resolution.fuzzy_duplicates(df).collect()
    assert len(rows) == 50 and [r["similarity"] for r in rows] == sorted((r["similarity"] for r in rows), reverse=True)


def test_aliases(spark):
    table = {r["alias"]: r["canonical"] for r in resolution.alias_table(spark, {"a": "b", "b": "c", "GV": "Google Ventures", "Google Ventures": "GV", "SV": "SV"}).collect()}
    assert table == {"a": "c", "b": "c", "GV": "Google Ventures"}
    g = resolution.apply_aliases(graph_of(spark, ["GV", "Google Ventures", "SV Angel", "Tiger", "Tiger Global Management", "a16z", "Other"], [(0, 0), (1, 0), (3, 0), (4, 1), (5, 1), (2, 0)]))
    assert sorted(r["name"] for r in g.node("Investor").collect()) == ["Andreessen Horowitz", "Google Ventures", "Other", "SV Angel", "Tiger Global"]
    assert mutation.dangling(g).count() == 0 and g.edge("INVESTED_IN").count() == 5
    again = resolution.apply_aliases(g)
    assert {tuple(r) for r in again.node("Investor").collect()} == {tuple(r) for r in g.node("Investor").collect()}


def test_similar_names_are_merged_in_chains(spark):
    names = ["Accelerate Fund", "Accelerate Funds", "Accelerate Fundss", "Zebra", "Zebrb", "Quite Different"]
    g, report = resolution.deduplicate(graph_of(spark, names, [(0, 0), (1, 1), (2, 1), (3, 0)]), auto_merge=True)
    assert sorted(r["name"] for r in g.node("Investor").collect()) == ["Accelerate Fundss", "Quite Different", "Zebra"] or "Zebrb" in [r["name"] for r in g.node("Investor").collect()]
    assert mutation.dangling(g).count() == 0
    assert report.where("label = 'Investor'").count() >= 3
    same, _ = resolution.deduplicate(graph_of(spark, names), auto_merge=False)
    assert same.node("Investor").count() == 6


def test_merge_query_takes_both_labels_at_the_bound_of_the_operator(spark, tmp_path):
    pairs = [("Investor", "Brolu Ventures", "Brolu Vontures"), ("Founder", "Anna Depoblegu", "Anna Depablego"), ("Company", "Klepo Foods", "Klipo Foods")]
    assert all(0.92 < fn.jaro_winkler(a.lower(), b.lower()) <= 0.97 for _, a, b in pairs)
    rows = [(10 * i + k, label, name) for i, (label, *names) in enumerate(pairs) for k, name in enumerate([*names, "Quite Different"])]
    spark.createDataFrame(rows, "node_id long, label string, name string").write.parquet(f"{tmp_path}/entity_name.parquet")
    assert {tuple(r) for r in processing.merge_similar_names(spark, str(tmp_path)).collect()} == {("Investor", 2), ("Founder", 2)}


def test_report_query_has_all_labels(spark, tmp_path):
    rows = [(10 * i + k, label, f"{label} {name}") for i, label in enumerate(["Investor", "Founder", "Company"]) for k, name in enumerate(["Depoblegu", "Depablegu"])]
    spark.createDataFrame(rows, "node_id long, label string, name string").write.parquet(f"{tmp_path}/entity_name.parquet")
    got = [tuple(r) for r in processing.fuzzy_report(spark, str(tmp_path)).collect()]
    assert sorted((label, line[7:]) for label, line in got) == [(label, f"{label} Depablegu ↔ {label} Depoblegu") for label in ("Company", "Founder", "Investor")]


@pytest.mark.parametrize("limit", [3, 8, 500])
def test_top_list_is_that_of_all_pairs(spark, limit):
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(40)} | {"abcda", "ABCDA", "aBCDA"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((-s, a, b) for a, b in itertools.combinations(names, 2) if (s := fn.jaro_winkler(a.lower(), b.lower())) > 0.85)
    assert [(-r["similarity"], r["name1"], r["name2"]) for r in resolution.fuzzy_duplicates(df, 0.85, limit).collect()] == want[:limit]


def test_connected_chains(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("x", "y"), ("z", None)], "a string, b string")
    got = {r["node"]: r["root"] for r in resolution.connected(chain).collect()}
    assert len(got) == 123 and {v for k, v in got.items() if k.startswith("n")} == {"n000"} and got["y"] == "x"
    assert resolution.connected(chain.limit(0)).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße Inc.",), (None,)], "n string")
    r = df.select(fn.alternate_names(F.col("n")).alias("a"), fn.casefold(F.col("n")).alias("c"), fn.page_url(F.col("n")).alias("u")).collect()
    assert r[0]["a"] == ["Straße Inc. startup", "Straße Inc. Inc", "Straße Inc. Inc.", "Straße"] and r[0]["c"] == "strasse inc." and r[0]["u"].endswith("/Straße_Inc.")
    assert r[1]["c"] is None
    ips = spark.createDataFrame([(None, "1.2.3.4:55, 9.9.9.9", "7.7.7.7"), (" ", None, "2001:db8::1"), ("8.8.8.8", "1.1.1.1", "x")], "r string, f string, p string")
    assert [x[0] for x in ips.select(fn.client_ip(F.col("r"), F.col("f"), F.col("p"))).collect()] == ["1.2.3.4", "2001:db8::1", "8.8.8.8"]
    nums = spark.createDataFrame([("has 12 in", 12), ("has 112 in", 12), ("has 12.5", 12)], "t string, n int")
    assert [x[0] for x in nums.select(fn.mentions_number(F.col("t"), F.col("n"))).collect()] == [True, False, False]
    cats = spark.createDataFrame([(["ai", "AI", "Go", "go", "Artificial Intelligence"],), (None,)], "c array<string>")
    assert [x[0] for x in cats.select(fn.canonical_categories(F.col("c"))).collect()] == [["Artificial Intelligence", "Go"], None]

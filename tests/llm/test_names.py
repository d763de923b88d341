import itertools
import random

import pytest

from vinculo.llm import names as N

GROUPS = [
    ("Founder", ["Abigail Depobleglu", "DEPOBLEGLU Abigail", "Depobleglu, Abigail", "abigail.depobleglu", "A. Depobleglu", "Abby Depobleglu", "Dr. Abigail Depobleglu", "Abigail Depobelglu", "Ábigail Depo bleglu"]),
    ("Founder", ["Celeste Depobleglu"]),
    ("Founder", ["Gustavo Aylin Huflairaite", "gus huflairaite", "Gustavo A. Huflairaite"]),
    ("Company", ["Klepo Spubli Logistics", "klepo-spubli-logistics", "Klepo Spubli Log.", "KlepoSpubli Logistics, Inc.", "Logistics Klepo Spubli", "Kleppo Spubli Logistics", "Klepo Spubli Logistics (formerly Kelpo)"]),
    ("Company", ["Drihastenai Security"]),
    ("Company", ["Drihastenai Analytics", "Drihastenai Anlytcs"]),
    ("Investor", ["Bloga & Fitru Equity Group", "Fitru and Bloga Equity Group", "Bloga Fitru Eq. Grp", "B. Fitru Equity Group"]),
    ("Investor", ["Drushe Nove Growth III", "Drushe Nove Growth III, L.P."]),
    ("Investor", ["Drushe Nove Growth IV"]),
]


def nodes(spark):
    rng = random.Random(4)
    syllable = lambda: rng.choice(["ka", "bru", "ti", "sme", "plo", "dai", "ve", "gru"])
    rows = [(i, label, n) for i, (label, n) in enumerate((label, n) for label, g in GROUPS for n in g)]
    firsts = ["Abigail", "Celeste", "Gustavo", "Aylin"]
    # what is common is found by counting, so there must be something to count
    more = [(1000 + i, "Founder", f"{firsts[i % 4]} {''.join(syllable() for _ in range(5)).title()}") for i in range(60)]
    more += [(2000 + i, "Company", f"{''.join(syllable() for _ in range(6)).title()} {('Logistics', 'Security', 'Analytics')[i % 3]}") for i in range(60)]
    more += [(3000 + i, "Investor", f"{''.join(syllable() for _ in range(3)).title()} {''.join(syllable() for _ in range(3)).title()} Equity Group") for i in range(40)]
    return rows, spark.createDataFrame([(*r, 1, 1) for r in rows + more], "node_id long, label string, name string, core int, id int")


def test_groups(spark):
    rows, df = nodes(spark)
    want, at = set(), 0
    for _, g in GROUPS:
        want |= set(itertools.combinations(range(at, at + len(g)), 2))
        at += len(g)
    got = {tuple(r) for r in N.variants(df).collect()}
    assert {p for p in got if max(p) < 1000} == want


def test_typos_on_several_nodes_are_linked(spark):
    rows = [(i, "Company", n) for i, n in enumerate(["Drihastenai Security"] * 3 + ["Drihastemai Security"] * 2)]
    rows += [(10 + i, "Founder", n) for i, n in enumerate(["Abigail Depobleglu"] * 2 + ["Abigail Depoblaglu"] * 2)]
    got = {tuple(r) for r in N.variants(spark.createDataFrame(rows, "node_id long, label string, name string")).collect()}
    assert got == set(itertools.combinations(range(5), 2)) | set(itertools.combinations(range(10, 14), 2))


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def within(a, b, k):
    """The distance of a and b, a swap of neighbours and nothing else being one edit; None above k."""
    if any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)):
        return 1 if k else None
    d = lev(a, b)
    return d if d <= k else None


def allowed(n, bounds):
    return sum(n >= x for x in bounds)


@pytest.mark.parametrize("spare", [1, 2, 3])
def test_segment_join_matches_brute_force(spark, spare):
    rng = random.Random(9)
    texts = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 11))) for _ in range(250)})
    rows = [(rng.choice("xy"), t, 3, 0) for t in texts]
    want = set()
    for (b1, s, *_), (b2, t, *_) in itertools.combinations(rows, 2):
        k = allowed(min(len(s), len(t)), N.EDITS)
        if b1 == b2 and (d := within(s, t, k)) is not None:
            want.add((b1, *((s, t) if len(s) > len(t) or len(s) == len(t) and s < t else (t, s)), d))
    df = spark.createDataFrame(rows, "block string, text string, role int, up int")
    assert {tuple(r) for r in N.segment_pairs(df, spare).collect()} == want


def test_probes_find_longer_texts_and_hot_keys_are_dealt(spark, monkeypatch):
    rng = random.Random(3)
    texts = list({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(300)})
    rows = [("x", t, 1 + i % 2, 1) for i, t in enumerate(texts)]
    want = {("x", s, t, d) for _, s, r, _ in rows if r == 1 for _, t, q, _ in rows if q == 2 and (d := within(s, t, allowed(len(t), N.TOKEN_EDITS))) is not None}
    monkeypatch.setattr(N, "KEY_ROWS", 3)
    monkeypatch.setattr(N.dealt_join, "__defaults__", (3,))
    df = spark.createDataFrame(rows, "block string, text string, role int, up int")
    assert {tuple(r) for r in N.segment_pairs(df, bounds=N.TOKEN_EDITS).collect()} == want


def test_common_words_do_not_depend_on_size(spark):
    """Many names more make no first name of a surname and none less of a first name."""
    rng = random.Random(5)
    coined = lambda: "".join(rng.choice(["ka", "bru", "ti", "sme", "plo", "dai", "ve", "gru"]) for _ in range(4))
    for n in (40, 4000):
        rows = [("Founder", ["fiona", coined()]) for _ in range(n // 4)] + [("Founder", [coined(), "smith"]) for _ in range(n)] + [("Investor", ["kestrel" if i % 9 else coined(), coined() if i % 9 else "kestrel", "capital"] if i % 3 else [coined(), coined(), "capital"]) for i in range(n // 4)]
        got = {tuple(r)[:2] for r in N.common_words(spark.createDataFrame(rows, "label string, words array<string>")).collect()}
        assert ("Founder", "fiona") in got and ("Founder", "smith") not in got and ("Investor", "capital") in got and ("Investor", "kestrel") not in got


def test_a_name_that_leaves_something_out_joins_only_one(spark, monkeypatch):
    rows = [(1, "Founder", "Abigail Depobleglu"), (2, "Founder", "A. Depobleglu"), (3, "Founder", "Andrew Krusmebasi"), (4, "Founder", "Abigail Krusmebasi"), (5, "Founder", "A. Krusmebasi")]
    rows += [(11, "Investor", "Bloga Fitru Growth Fund"), (12, "Investor", "Bloga & Fitru GF"), (13, "Investor", "Bloga Fitru"), (14, "Investor", "Smowi Flifai Capital"), (15, "Investor", "Smowi Flifai Angels"), (16, "Investor", "Smowi Flifai")]
    want = {(1, 2), (11, 12), (11, 13), (12, 13)}
    monkeypatch.setattr(N, "PAIR_ROWS", 2)  # large groups are dealt out
    own = N.members(spark.createDataFrame(rows, "node_id long, label string, name string"))
    assert {tuple(r) for r in N.pairs(own).collect()} == want
    classes = {r["node_id"]: (r["class_id"], r["links"]) for r in N.class_rows(own).collect()}
    assert classes == {i: (i, 0) for i in (3, 4, 5, 14, 15, 16)} | {1: (1, 1), 2: (1, 1), 11: (11, 2), 12: (11, 2), 13: (11, 2)}


def test_nulls_repeats_and_empty(spark):
    schema = "node_id long, label string, name string"
    df = spark.createDataFrame([(1, "Company", "Brolu Foods"), (1, "Company", "Brolu Foods"), (2, "Company", "BROLU FOODS"), (3, "Company", None), (None, "Company", "Brolu Foods"), (4, None, "Brolu Foods"), (5, "Company", ""), (6, "Company", "  "), (7, "Company", "!!!"), (8, "Company", "w " * 5000), (9, "Founder", "X")], schema)
    assert {tuple(r) for r in N.variants(df).collect()} == {(1, 2)}
    assert N.variants(df.limit(0)).count() == 0

import datetime as dt
import random

from pyspark.sql import functions as F

from vinculo.llm import survivorship as S

SCHEMA = "record_id long, company_id long, description string, status string, stage string, team_size int, source string, updated_at timestamp, loaded_at timestamp, mask int, trust int"
T0 = dt.datetime(2024, 1, 1)


def filled(row):
    d, s, g, n = row[2:6]
    return {
        "description": d is not None and d not in ("", " ", "-", "n/a", "[description]", "No description available."),
        "status": s is not None and s.strip().lower() in S.STATUSES, "stage": g is not None and g.strip().lower() in S.STAGES, "team_size": n is not None and n > 0,
    }


def brute(rows, trust):
    out = set()
    for c in {r[1] for r in rows} - {None}:
        own = {r[0]: r for r in rows if r[1] == c}
        if len(own) < 2:
            continue
        for f in S.FIELDS:
            have = [r for r in own.values() if filled(r)[f]]
            if have:
                best = min(have, key=lambda r: (-trust.get(r[6], -1), -(r[7] or dt.datetime.min).timestamp() if r[7] else float("inf"), r[0]))
                out.add((c, f, best[0]))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(11)
    trust = {"a": 1, "b": 2, "c": 2}
    rows = []
    for i in range(400):
        rows.append((i, rng.randrange(60), rng.choice([None, "", "-", "n/a", "[description]", "No description available.", "Maps.", "Tools"]), rng.choice([None, "Active", " dead ", "Unknown", "?"]), rng.choice([None, "Early", "gROWTH", "n/a"]), rng.choice([None, 0, -1, 5, 7]), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, T0, T0 + dt.timedelta(days=rng.randrange(3))]), T0, 0, 0))
    rows += rng.sample(rows, 40)
    records = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(list(trust.items()), "source string, trust int")
    assert {tuple(r) for r in S.chosen_records(records, table).collect()} == brute(rows, trust)
    got = {r["company_id"]: r for r in S.survivors(records, table).collect()}
    assert len(got) == len({r[1] for r in rows})
    for c, f, i in brute(rows, trust):
        assert got[c][f"{f}_from"] == i
    assert {r["status"] for r in got.values()} <= {None, "Active", "Dead"} and {r["stage"] for r in got.values()} <= {None, "Early", "Growth"}


def test_layers_follow_dominance(spark):
    rows = [(1, 1, "Maps.", "Active", None, None, "b", T0, T0, 0, 0), (2, 1, "Maps.", None, None, None, "a", T0, T0, 0, 0), (3, 1, None, None, "Early", None, "a", T0, T0, 0, 0)]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "source string, trust int")
    c = S.layers(S.candidates(spark.createDataFrame(rows, SCHEMA), table)).collect()[0]["c"]
    assert {x["x"]["record_id"]: x["layer"] for x in c} == {1: 1, 2: 2, 3: 1}


def test_nulls_and_empty(spark):
    rows = [(None, 1, "Maps.", None, None, None, "a", T0, T0, 0, 0), (1, None, "Maps.", None, None, None, "a", T0, T0, 0, 0), (2, 5, None, None, None, None, None, None, T0, 0, 0), (3, 5, None, None, None, None, None, None, T0, 0, 0)]
    table = spark.createDataFrame([("a", 1)], "source string, trust int")
    df = spark.createDataFrame(rows, SCHEMA)
    assert S.chosen_records(df, table).count() == 0
    assert S.survivors(df, table).count() == 1
    assert S.chosen_records(df.limit(0), table).count() == 0
    assert S.chosen_records(df, table.limit(0)).count() == 0


def test_stand_ins(spark):
    texts = ["No summary provided", "Description coming soon", "(none)", "TBD", "to be added", "...", "N/A", "<description>", "no description yet", "No more paper forms for nurses.", "Helps nurses", "Unknown Worlds maps caves"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.states_text(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == [False] * 9 + [True] * 3

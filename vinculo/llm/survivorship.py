"""The best representative of each duplicate group (problem 4): a skyline of the records, resolved field by field.

Records of a group are compared on completeness (which fields they state), trust of their source and recency. One
record dominates another if it states every field the other states, has at least its trust and is at least as recent
(of equally old records the smaller id counts as the more recent). Layer 1 are the undominated records, layer n those
whose longest chain of dominating records has n - 1 members. The survivor starts from the best record of layer 1 by
the lexicographic policy (trust, then recency, then smallest id); a field it leaves empty comes from the best record
that states it in the lowest layer that has one. A record that is best for a field by the policy can only be
dominated by a record that is better for it too, so layer 1 holds the policy's choice of every field.

Groups of any size: per group only the best record of each (fields stated, trust) is kept, which a map-side aggregate
does. The others of such a cell are dominated by it and can fill nothing. So at most 2^fields x trusts records of a
group, 112 here, come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a status and a stage may state, and texts that state nothing.
STATUSES = ["active", "acquired", "public", "dead"]
STAGES = ["early", "growth", "public"]
STAND_INS = [
    "n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "unknown", "not known", "undefined", "unspecified", "not specified", "not available", "unavailable",
    "not provided", "not given", "not stated", "none given", "to be added", "to be announced", "to be confirmed", "to be defined", "to be determined", "to be written", "to follow",
    "description", "summary", "empty", "missing", "pending", "placeholder", "text", "todo", "x", "xx", "xxx", "test", "no data", "no info", "no information", "coming soon", "lorem ipsum",
    "see website", "same as above", "blank", "nothing", "void", "default",
]
STAND_IN_SENTENCE = (
    r"^(no|without) (company |short |long )?(description|summary|profile|text|information|info|details?|data)( (is |was )?(yet |currently )?(available|provided|given|entered|found|added|supplied|set|on file|yet))*( yet)?$"
    r"|^(company |short )?(description|summary|profile|text|details?) (is |will be |to be )?(coming soon|pending|missing|to follow|follows|unavailable|tba|tbd|not (yet )?(available|provided|given|set|known)|to be (added|written|provided|announced)|added (soon|later)|goes here|here)$"
    r"|^(add|enter|insert|put|write|your) (a |your |the )?(company )?(short )?(description|summary|text)( here)?$"
)


def states_text(c: Column) -> Column:
    """Whether a free text states something: not null, blank, punctuation only, bracketed, or a stand-in."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    bracketed = F.trim(c).rlike(r"^(\[[^\]]*\]|<[^>]*>|\{+[^}]*\}+)$")
    return F.coalesce((words != "") & ~bracketed & ~words.isin(STAND_INS) & ~words.rlike(STAND_IN_SENTENCE), F.lit(False))


def _one_of(c: Column, values: list[str]) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(c, r"^[\s ​﻿]+|[\s ​﻿]+$", "")).isin(values), F.lit(False))


#: The fields of a company and when each states something, in the order of the bits of the mask.
FIELDS = {
    "description": lambda: states_text(F.col("description")),
    "status": lambda: _one_of(F.col("status"), STATUSES),
    "stage": lambda: _one_of(F.col("stage"), STAGES),
    "team_size": lambda: F.coalesce(F.col("team_size") > 0, F.lit(False)),
}


def candidates(records: DataFrame, trust: DataFrame, fields=FIELDS, *, values: bool = True) -> DataFrame:
    """``company_id, several, c`` with ``c`` the records that can be needed of each company, best first.

    A source without a trust has trust below all others; a null ``updated_at`` is older than any; rows with a null
    company or record are left out; repeated deliveries of a record change nothing. Without ``values`` only ids are
    carried, not what the fields state.
    """
    mask = sum((F.when(test(), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(fields.values())), F.lit(0))
    carried = list(fields) if values else []
    # the table of trusts is small and fixed, one row per source; it is joined by its size
    known = trust.groupBy(F.col("source").alias("__source")).agg(F.max("trust").alias("__trust"))
    rows = (
        records.where(F.col("company_id").isNotNull() & F.col("record_id").isNotNull())
        .join(known, F.col("source") == F.col("__source"), "left")
        .select("company_id", "record_id", mask.alias("mask"), F.coalesce("__trust", F.lit(-1)).alias("trust"), F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))).alias("recent"), *carried)
    )
    rank = F.struct(F.col("recent"), -F.col("record_id"))
    cells = rows.groupBy("company_id", "mask", "trust").agg(
        F.max_by(F.struct("record_id", "recent", *carried), rank).alias("r"), F.min("record_id").alias("lo"), F.max("record_id").alias("hi")
    )
    item = F.struct((-F.col("trust")).alias("a"), (-F.col("r.recent")).alias("b"), F.col("r.record_id").alias("record_id"), "trust", F.col("r.recent").alias("recent"), "mask", *([F.struct(*[F.col(f"r.{f}") for f in carried]).alias("f")] if values else []))
    return cells.groupBy("company_id").agg((F.min("lo") < F.max("hi")).alias("several"), F.array_sort(F.collect_list(item)).alias("c"))


def _dominates(y: Column, x: Column) -> Column:
    covers = y["mask"].bitwiseAND(x["mask"]) == x["mask"]
    recent = (y["recent"] > x["recent"]) | ((y["recent"] == x["recent"]) & (y["record_id"] <= x["record_id"]))
    same = (y["record_id"] == x["record_id"]) & (y["mask"] == x["mask"]) & (y["trust"] == x["trust"]) & (y["recent"] == x["recent"])
    return covers & (y["trust"] >= x["trust"]) & recent & ~same


def layers(cands: DataFrame) -> DataFrame:
    """Adds to each candidate its dominance ``layer``; a record's dominators all come before it in the order of ``c``."""
    kind = cands.schema["c"].dataType.elementType.simpleString()
    empty = F.expr(f"cast(array() as array<struct<x:{kind},layer:int>>)")

    def step(done: Column, x: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: _dominates(d["x"], x)), lambda d: d["layer"])
        return F.concat(done, F.array(F.struct(x.alias("x"), (F.coalesce(F.array_max(above), F.lit(0)) + 1).alias("layer"))))

    return cands.withColumn("c", F.aggregate("c", empty, step))


def _best(field_no: int) -> Column:
    """The candidate that fills a field: of the lowest layer that states it, the first by the policy; null if none does."""
    stating = F.filter("c", lambda d: d["x"]["mask"].bitwiseAND(F.lit(1 << field_no)) != 0)
    lowest = F.array_min(F.transform(stating, lambda d: d["layer"]))
    return F.get(F.filter(stating, lambda d: d["layer"] == lowest), F.lit(0))["x"]


def chosen_records(records: DataFrame, trust: DataFrame, fields=FIELDS) -> DataFrame:
    """``company_id, field, record_id``: the record that fills each field of the companies with several records."""
    ranked = layers(candidates(records, trust, fields, values=False).where("several"))
    picks = F.array(*[F.struct(F.lit(f).alias("field"), _best(i)["record_id"].alias("record_id")) for i, f in enumerate(fields)])
    return ranked.select("company_id", F.inline(picks)).where("record_id is not null")


def _tidy(field: str, value: Column) -> Column:
    """Texts without outer blanks; states in one spelling."""
    return F.initcap(F.trim(value)) if field in ("status", "stage") else F.trim(value) if field == "description" else value


def survivors(records: DataFrame, trust: DataFrame, fields=FIELDS) -> DataFrame:
    """One record for each company: ``company_id``, each field's value, and the record it comes from.

    A company with one record survives as it is, its empty and stand-in values as nulls. Outer blanks go, and status and
    stage come in one spelling.
    """
    ranked = layers(candidates(records, trust, fields))
    base = F.get(F.filter("c", lambda d: d["layer"] == 1), F.lit(0))["x"]["record_id"].alias("record_id")
    n = F.array_max(F.transform("c", lambda d: d["layer"])).alias("n_layers")
    ranked = ranked.select("company_id", base, n, *[_best(i).alias(f"_{f}") for i, f in enumerate(fields)])
    return ranked.select("company_id", "record_id", "n_layers", *[_tidy(f, F.col(f"_{f}.f.{f}")).alias(f) for f in fields], *[F.col(f"_{f}.record_id").alias(f"{f}_from") for f in fields])

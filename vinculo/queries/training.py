"""The general operators for training data: p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.amounts import stated_sum
from ..operators.units import convert, money_graph
from ..runtime import table

#: There are fewer currencies in the world than rates that the driver takes.
MAX_RATES = 10_000


def funding_in_usd(events: DataFrame, rates: DataFrame) -> DataFrame:
    """``event_id, amount_usd`` of each event whose amount states a sum, in whole dollars, once each.

    ``rates`` is a fixed table of one row for each currency. Events with a null id are left out; a sum in a currency
    without a rate has none to state. Repeated deliveries of an event come out once.
    """
    known = rates.select("currency", "usd_per_unit").distinct().limit(MAX_RATES + 1).collect()
    if len(known) > MAX_RATES:
        raise ValueError(f"a table of more than {MAX_RATES} rates isn't one of currencies")
    graph = money_graph([(r["currency"], r["usd_per_unit"]) for r in known])
    sums = events.where("event_id is not null and amount is not null").select("event_id", stated_sum(F.col("amount"), F.col("currency"), F.col("note")).alias("s")).where("s.unit is not null")
    converted = convert(sums, F.col("s.quantity"), F.col("s.unit"), F.lit("USD"), graph.table(events.sparkSession, "USD"))
    return converted.where("canonical is not null").groupBy("event_id").agg(F.min(F.round("canonical", 0).cast("long")).alias("amount_usd"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return funding_in_usd(table(spark, d, "funding_event"), table(spark, d, "fx_rate"))


QUERIES = {"p6_found": p6_found}

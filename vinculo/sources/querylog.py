"""The log of questions: append-only parquet, one folder for each UTC day; and places of client addresses."""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "row_key string, ip_address string, country string, region string, city string, latitude double, longitude double, question string, method string, cypher string, cypher_result string, "
    "answer string, result_count int, duration double, status string, error string, timestamp_utc string, log_date string"
)
PLACE = {"country": "", "region": "", "city": "", "latitude": None, "longitude": None}


def locate(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """Requests (``ip_address``) with their place by ranges of IPv4 numbers (``start, end`` and place columns).

    An address outside all ranges, and one that isn't IPv4, has empty texts and null coordinates. Ranges don't
    overlap; they are joined on their first byte, so no range meets every request.
    """
    parts = F.split("ip_address", r"\.")
    number = F.when(F.col("ip_address").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), sum((F.get(parts, F.lit(i)).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0)))
    asked = requests.withColumn("__ip", number).withColumn("__byte", F.floor(F.col("__ip") / 2**24))
    spans = ranges.withColumn("__byte", F.explode(F.sequence(F.floor(F.col("start") / 2**24), F.floor(F.col("end") / 2**24))))
    found = asked.join(spans, (asked["__byte"] == spans["__byte"]) & (F.col("__ip") >= F.col("start")) & (F.col("__ip") <= F.col("end")), "left")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("country", "region", "city")]
    return found.select(*requests.columns, *texts, "latitude", "longitude")


def append(spark: SparkSession, path: str, **row) -> bool:
    """Add one question to the log. A failure is logged and told, never raised: answering goes on."""
    try:
        now = datetime.now(timezone.utc)
        values = PLACE | {"error": "", "status": "success"} | row | {"timestamp_utc": now.isoformat(), "log_date": now.strftime("%Y-%m-%d")}
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        df = spark.createDataFrame([tuple(values.get(n) for n in names)], SCHEMA).withColumn("row_key", F.uuid())
        df.coalesce(1).write.mode("append").partitionBy("log_date").parquet(path)
        return True
    except Exception:  # noqa: BLE001
        logging.getLogger(__name__).exception("the question couldn't be logged")
        return False


def daily(log: DataFrame) -> DataFrame:
    """``log_date, status, n, mean_duration`` of a log."""
    return log.groupBy("log_date", "status").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration"))

"""Resumable loading: new document files since the last run, each once, by a file stream with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import loader


def new_documents(spark: SparkSession, folder: str, *, max_files: int | None = None) -> DataFrame:
    """A stream of ``filename, content`` of the text files of a folder."""
    reader = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.txt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("content"))


def load_new(spark: SparkSession, folder: str, out: str, checkpoint: str, *, max_files: int | None = None) -> None:
    """Load what has arrived: parsed documents go to ``out/documents``, their statuses to ``out/manifest``.

    A batch is written under its number, so a batch that is repeated after a failure replaces itself. The graph is
    built from all documents, for a later file may overwrite an earlier company.
    """

    def batch(rows: DataFrame, number: int) -> None:
        parsed = loader.parse_documents(rows.where(F.trim("content") != ""))
        parsed.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        status = F.when(F.col("problem").isNull(), "loaded").otherwise("failed").alias("status")
        parsed.select("filename", status).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")

    stream = new_documents(spark, folder, max_files=max_files)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def loaded_graph(spark: SparkSession, out: str):
    """The graph of all documents loaded so far."""
    return loader.build(spark.read.parquet(f"{out}/documents").drop("batch"))


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` of a stream or table of events by time window; late events have ``late`` to come."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

"""Shared run-time helpers: durable intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 64


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = f"file://{tempfile.gettempdir()}/vinculo-{os.getpid()}"
    return root.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a cluster, once for each application; locally they find it themselves."""
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.startswith("local") or app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='vinculo-')}/vinculo", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def durable(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage: the files outlive any executor. They are removed when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "snappy")  # written and read once: speed counts more than size
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``durable`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tables/" in name:
            hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def lookup(left: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``left`` with ``dim``, whose ``key`` is unique, when a few keys may hold most of ``left``.

    Keys above 1/HOT_SHARE of the rows (so fewer than HOT_SHARE of them) go to a broadcast join, the rest to a
    shuffled one. Both inputs are read twice and should be stored tables. Null keys match nothing and, with
    ``how="left"``, stay in the result.
    """
    total = left.count()
    hot = [r[0] for r in left.groupBy(key).count().where((F.col("count") > max(1000, total / HOT_SHARE)) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(dim, key, how)
    is_hot = F.col(key).isin(hot)
    few = F.broadcast(dim.where(is_hot))
    cold = left.where(~F.coalesce(is_hot, F.lit(False)))
    return left.where(is_hot).join(few, key, how).unionByName(cold.join(dim.where(~is_hot), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""JSON sinks: a table that is replaced as a whole, and a log that grows by lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_json(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and put it in its place by renaming, so that readers see the old table or the new one.

    The old table is kept under another name until the new one stands, and put back if that fails.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    df.write.json(f"{path}.{mark}.new")
    target, files = _files(spark, path)
    new, old = (_files(spark, f"{path}.{mark}.{end}")[0] for end in ("new", "old"))
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"{path} cannot be moved")
    if not files.rename(new, target):
        if had:
            files.rename(old, target)
        raise OSError(f"{path} cannot be replaced")
    if had:
        files.delete(old, True)


def append_log(df: DataFrame, path: str, at: Column) -> None:
    """Append rows as JSON lines, a folder a day; earlier lines are never written again."""
    df.withColumn("at", at).withColumn("day", F.to_date("at")).write.partitionBy("day").mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """Lines of a log, from a day on if given: only those days' folders are read."""
    log = spark.read.schema(f"{schema}, at timestamp, day date").json(path)
    return log if since is None else log.where(F.col("day") >= F.lit(since).cast("date"))

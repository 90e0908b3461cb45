"""Rollups that survive restarts: counts by hour and kind, a durable watermark, replay of a log, and windows that are let go.

Every batch of a run writes its counts under the run's and its own number, by day, and then the greatest time it has seen. A batch that
is run again replaces itself, so a job that is killed and started from its checkpoint counts every event once. A run belongs to its
checkpoint folder. One that begins with a new checkpoint, over a log that earlier runs have read, is a replay: it notes the
durable watermark once, when it first starts, and counts only events after it. While a run lives, late events are counted like
all others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "bucket timestamp, kind string, n long, run string, epoch long, day date"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [str(f.getPath()) for f in fs.listStatus(where)] if fs.exists(where) else []


def watermark(spark: SparkSession, path: str) -> int | None:
    """The greatest event time that has been counted, in microseconds."""
    marks = _folders(spark, f"{path}/marks")
    return spark.read.schema("us long").parquet(*marks).agg(F.max("us")).first()[0] if marks else None


def _floor(spark: SparkSession, path: str, run: str) -> int | None:
    """What the run need not count, noted when it first starts."""
    fs, where = _fs(spark, f"{path}/runs/{run}")
    if fs.exists(where):
        text = spark.read.text(str(where), wholetext=True).first()[0].strip()
        return None if text == "none" else int(text)
    now = watermark(spark, path)
    out = fs.create(where, False)
    out.write(bytearray(str("none" if now is None else now).encode()))
    out.close()
    return now


def fold(events: DataFrame, path: str, checkpoint: str):
    """A writer (to be started) that counts the stream ``events(ts timestamp, kind)`` below ``path``. Use one checkpoint folder for as
    long as the job is the same; a new one replays."""
    spark, run = events.sparkSession, hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    floor = _floor(spark, path, run)
    kind = F.when(F.trim(F.coalesce("kind", F.lit(""))) == "", "unknown").otherwise(F.col("kind"))
    us = F.expr("unix_micros(ts)")

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch if floor is None else batch.where(us > floor)
        own = own.select("ts", kind.alias("kind"))
        counts = own.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "kind").agg(F.count("*").alias("n"))
        counts = counts.withColumns({"run": F.lit(run), "epoch": F.lit(epoch).cast("long"), "day": F.to_date("bucket")})
        for old in _folders(spark, f"{path}/counts"):  # days; what an earlier try of this batch has left
            fs, where = _fs(spark, f"{old}/run={run}/epoch={epoch}")
            fs.delete(where, True)
        counts.write.mode("append").partitionBy("day", "run", "epoch").parquet(f"{path}/counts")
        own.agg(F.max(us).alias("us")).where("us IS NOT NULL").write.mode("overwrite").parquet(f"{path}/marks/{run}-{epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def snapshot(spark: SparkSession, path: str, unit: str = "hour") -> DataFrame:
    """``(bucket, kind, n)`` by hour, or by day."""
    if not _folders(spark, f"{path}/counts"):
        return spark.createDataFrame([], "bucket timestamp, kind string, n long")
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    return counts.groupBy(F.date_trunc(unit, "bucket").alias("bucket"), "kind").agg(F.sum("n").alias("n"))


def let_go(spark: SparkSession, path: str, before: str) -> int:
    """Remove the counts of days before ``before`` (YYYY-MM-DD); the watermark stays. Returns how many days went."""
    gone = 0
    for folder in _folders(spark, f"{path}/counts"):
        day = folder.rsplit("day=", 1)[-1]
        if day[:2].isdigit() and day < before:
            fs, where = _fs(spark, folder)
            gone += bool(fs.delete(where, True))
    return gone

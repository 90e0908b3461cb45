"""The gate of idle passes: may one begin now, and if not, why not.

A pass may begin when the gate is armed, none is running, nothing has happened for the idle time, and the last pass ended at least
that long ago. The reasons are asked in this order, and the first that holds against it is the decision's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The reasons in order.
REASONS = ("disabled", "pass_in_flight", "not_idle", "gap_not_elapsed", "fire")


def decisions(log: DataFrame, idle_seconds: int) -> DataFrame:
    """``(key, id, reason, allow)`` of every tick in ``log(key, ts, id, what, armed)``; ``what`` is tick, touch (activity), begin or end (of a
    pass). What went before a tick is read from the log in order: the last activity, whether a pass has begun and not ended, and
    when the last one ended. Before any activity a key counts as active since its first row. A key's rows are one sorted
    stream, and only running values are kept of it."""
    before = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = lambda what, of: F.last(F.when(F.col("what") == what, F.col(of)), True).over(before)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.withColumn("us", us)
    seen = rows.withColumns({
        "active": F.coalesce(last("touch", "us"), F.first("us").over(before)),
        "ended": last("end", "us"),
        "state": F.last(F.when(F.col("what").isin("begin", "end"), F.col("what")), True).over(before),
    })
    idle = F.lit(idle_seconds * 1_000_000)
    reason = (
        F.when(~F.coalesce("armed", F.lit(False)) | F.lit(idle_seconds <= 0), REASONS[0])
        .when(F.col("state") == "begin", REASONS[1])
        .when(F.col("us") - F.col("active") < idle, REASONS[2])
        .when(F.col("ended").isNotNull() & (F.col("us") - F.col("ended") < idle), REASONS[3])
        .otherwise(REASONS[4])
    )
    return seen.where("what = 'tick'").select("key", "id", reason.alias("reason"), (reason == REASONS[4]).alias("allow"))

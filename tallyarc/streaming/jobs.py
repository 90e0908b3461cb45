"""Structured Streaming twins of the incremental operators. Each takes a streaming DataFrame and returns one; ``finish`` runs a job
over what there is now and gives its rows, for tests and for catching up."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyarc.operators.hints import Session
from tallyarc.session import scratch_path


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream. Times become instants, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    kind = F.when(F.trim(F.coalesce("kind", F.lit(""))) == "", "unknown").otherwise(F.col("kind"))
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), kind.alias("kind")).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("bucket"), "kind", "n")


def debounce(events: DataFrame, quiet: str = "1 second", late: str = "1 day") -> DataFrame:
    """One row for each burst of a path, when it has been quiet; none where the file was made and removed in it."""
    order = F.struct("ts", "id")
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "project_id", "path").agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"), F.min_by("op", order).alias("first_op"), F.max_by("op", order).alias("last_op")
    )
    return out.where("NOT (first_op = 'create' AND last_op = 'remove')").select("project_id", "path", "start", "last", "n", "last_op")


def presence(calls: DataFrame, ttl: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by heartbeats, each until it has been silent for ``ttl``."""
    out = calls.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), "session_id").agg(F.count("*").alias("calls"))
    return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the newest heartbeat of a task; a lease that has timed out is given once."""
    if state.hasTimedOut:
        holder, at, until = state.get
        state.remove()
        yield pd.DataFrame([(*key, holder, at, until, "expired")], columns=["project_id", "task_id", "holder", "heartbeat", "expires", "state"])
        return
    rows = pd.concat(list(batches)).sort_values(["heartbeat", "holder"])
    last = rows.iloc[-1]
    if not state.exists or int(last.heartbeat) >= state.get[1]:
        state.update((str(last.holder), int(last.heartbeat), int(last.expires)))
    holder, at, until = state.get
    if until > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(until)
    yield pd.DataFrame([(*key, holder, at, until, "held")], columns=["project_id", "task_id", "holder", "heartbeat", "expires", "state"])


def leases(heartbeats: DataFrame, ttl_minutes: int = 10, late: str = "1 day") -> DataFrame:
    """Leases as state by task, with event-time timers: ``held`` on each heartbeat, ``expired`` when the watermark passes."""
    ms = F.expr("unix_micros(ts) div 1000")
    rows = heartbeats.withWatermark("ts", late).select("project_id", "task_id", "holder", "ts", ms.alias("heartbeat"), (ms + ttl_minutes * 60_000).alias("expires"))
    return rows.groupBy("project_id", "task_id").applyInPandasWithState(_lease, "project_id string, task_id string, holder string, heartbeat long, expires long, state string", "holder string, heartbeat long, expires long", "append", GroupStateTimeout.EventTimeTimeout)


#: Microseconds without a call after which a session is over for good; keys of state that sessions are dealt to. A job's checkpoint
#: holds for the number it began with.
SESSION_ENDS, DEALT = 24 * 3600 * 1_000_000, 1 << 12


def _hints(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The sessions of a key: each has its state, the calls that wait for the watermark, and the time of its last call that was walked."""
    kept = {k: own for k, *own in json.loads(state.get[0])} if state.exists else {}
    if not state.hasTimedOut:
        for frame in batches:
            for k, *call in zip(*(frame[c].tolist() for c in ("session_id", "us", "id", "tool", "arg", "empty_result", "brief_stale")), strict=True):
                kept.setdefault(k, [None, [], 0])[1].append([int(call[0]), int(call[1]), *call[2:4], bool(call[4]), bool(call[5])])
    mark, out, left, timers = state.getCurrentWatermarkMs() * 1000, [], [], []
    for k, (session, waiting, last) in kept.items():
        waiting.sort(key=lambda w: (w[0], w[1]))
        due = sum(w[0] < mark for w in waiting)  # no call before the watermark can come any more
        if due:
            walked = Session(session)
            for us, id_, tool, arg, empty, stale in waiting[:due]:
                rule, _ = walked.call(id_, tool, arg, empty, stale)
                last = us
                if rule:
                    out.append((id_, k, rule))
            session, waiting = walked.dump(), waiting[due:]
        if waiting or last + SESSION_ENDS >= mark:
            left.append((k, session, waiting, last))
            timers.append(waiting[0][0] if waiting else last + SESSION_ENDS)
    if left:
        state.update((json.dumps(left),))
        state.setTimeoutTimestamp(max(mark, min(timers)) // 1000 + 1)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["id", "session_id", "rule_id"])


def hints(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """The rule engine with the sessions' state in the store. Calls wait until the watermark (the newest time less ``late``) has passed
    them and are walked in the order of their times, so however they come in batches, the rows are those of the walk over all
    of them; calls later than that are left out. A session that has been silent for a day is let go. Sessions are dealt by hash to
    ``DEALT`` keys, as a group of its own costs far more than a session's few calls."""
    dealt = F.pmod(F.xxhash64("session_id"), F.lit(DEALT)).cast("int").alias("dealt")
    rows = calls.withWatermark("ts", late).select(dealt, "id", "session_id", "ts", F.expr("unix_micros(ts)").alias("us"), "tool", "arg", "empty_result", "brief_stale")
    return rows.groupBy("dealt").applyInPandasWithState(_hints, "id long, session_id string, rule_id string", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _gate(idle_ms: int, pass_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentProcessingTimeMs(), []
        armed, active, ended, until = state.get if state.exists else (True, now, 0, 0)
        if 0 < until <= now:  # the pass that was running has ended
            ended, until = until, 0
        if not state.hasTimedOut:
            for frame in batches:
                for r in frame.itertuples():
                    armed = {"arm": True, "disarm": False}.get(r.what, armed)
                    if r.what == "touch":
                        active = now
                        if until:  # activity ends a pass
                            ended, until = now, 0
        reason = "disabled" if not armed else "pass_in_flight" if until else "not_idle" if now - active < idle_ms else "gap_not_elapsed" if ended and now - ended < idle_ms else "fire"
        out.append((key[0], reason, reason == "fire", now))
        if reason == "fire":
            until = now + pass_ms
        state.update((armed, active, ended, until))
        if armed:
            state.setTimeoutDuration(max(1, (until or max(active, ended) + idle_ms) - now))
        yield pd.DataFrame(out, columns=["key", "reason", "allow", "at"])

    return run


def idle_gate(signals: DataFrame, idle_ms: int, pass_ms: int) -> DataFrame:
    """The gate of idle passes on ``signals(key, what)`` (touch, arm, disarm) with processing-time timers: each signal and each timer
    gives a decision with its reason; one that fires starts a pass, which ends after ``pass_ms`` or by activity. The batch twin is
    ``operators.idlegate.decisions``."""
    return signals.groupBy("key").applyInPandasWithState(_gate(idle_ms, pass_ms), "key string, reason string, allow boolean, at long", "armed boolean, active long, ended long, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def signals(events: DataFrame, entries: DataFrame, path: str, checkpoint: str | None = None):
    """A sink that keeps staleness signals: every batch of file events is joined with the entries and written under its number, so a
    batch that is run again replaces itself; readers take the latest of an entry. ``checkpoint``: the folder of the job's offsets; with the same one a job goes on where it was."""
    from tallyarc.operators.staleness import stale_by_path

    def write(batch: DataFrame, epoch: int) -> None:
        stale_by_path(entries, batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or scratch_path(events.sparkSession, "offsets"))


def finish(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """What a job has given once it has read all there is, written in ``folder`` (else a fresh one in the shared folder), where its state
    and offsets are too, so calling again with the same folder goes on where it ended: all rows of an appending job, or the
    last whole result of one that gives it anew each time."""
    spark, path = stream.sparkSession, folder or scratch_path(stream.sparkSession, "stream")
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows-{epoch:09d}")

    sink.foreachBatch(write).start().awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    whole = sorted(n for n in names if n.startswith("rows-"))
    return spark.read.schema(stream.schema).parquet(f"{path}/{whole[-1]}") if whole else spark.createDataFrame([], stream.schema)

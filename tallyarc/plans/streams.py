"""Queries of the streaming twins, run over all events there are."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.streaming import jobs as J
from tallyarc.views import Views


@query("rollup_stream", """WITH half AS (SELECT max(event_id) / 2 AS h FROM events), seen AS (SELECT max(ts) AS mark FROM events, half WHERE event_id <= h)
    SELECT date_trunc('hour', ts) AS bucket, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS kind, count(*) AS n FROM events, half, seen WHERE event_id <= h OR ts > mark GROUP BY ALL""")
def rollup_stream(v: Views):
    """The first half of the events by id, then, after its offsets are lost, the whole log again: what is beyond the watermark counts."""
    from tallyarc.session import scratch_path
    from tallyarc.streaming import rollups as R

    path, events = scratch_path(v.spark, "rollups"), J.events_stream(v.spark, v.sf_dir)
    half = v.events.agg(F.max("event_id") / 2).first()[0] or 0
    kind = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("kind")
    for name, rows in (("first", events.where(F.col("event_id") <= half)), ("again", events)):
        R.fold(rows.select("ts", kind), f"{path}/rollups", f"{path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return R.snapshot(v.spark, f"{path}/rollups").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("debounce_stream", """WITH f AS (SELECT event_id AS id, concat('src', @str(user_id % 20)) AS project_id, concat('docs/part_', @str(user_id % 50), '.md') AS path, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'write' END AS op FROM events),
    r AS (SELECT *, sum(new) OVER (PARTITION BY project_id, path ORDER BY ts, id) AS run FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY project_id, path ORDER BY ts, id)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM f) x),
    g AS (SELECT project_id, path, run, min(ts) AS start, max(ts) AS last, count(*) AS n, arg_min(op, struct_pack(a := ts, b := id)) AS first_op, arg_max(op, struct_pack(a := ts, b := id)) AS last_op FROM r GROUP BY ALL)
    SELECT project_id, path, start, last, n, last_op FROM g WHERE NOT (first_op = 'create' AND last_op = 'remove')""")
def debounce_stream(v: Views):
    own = J.events_stream(v.spark, v.sf_dir).selectExpr("event_id AS id", "concat('src', user_id % 20) AS project_id", "concat('docs/part_', user_id % 50, '.md') AS path", "ts", "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'write' END AS op")
    out = J.finish(J.debounce(own, "1 hour"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query("presence_stream", """WITH f AS (SELECT event_id AS id, concat('s', @str(user_id)) AS session_id, ts FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, id) AS run FROM
    (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM f) x) SELECT session_id, min(ts) AS start, count(*) AS calls FROM r GROUP BY session_id, run""")
def presence_stream(v: Views):
    own = J.events_stream(v.spark, v.sf_dir).selectExpr("concat('s', user_id) AS session_id", "ts")
    return J.finish(J.presence(own), "complete").select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), "calls")


@query("lease_stream", "SELECT concat('p', @str(user_id % 8)) AS project_id, concat('QUEST-', @str(user_id)) AS task_id, epoch_us(max(ts)) // 1000 AS heartbeat FROM events GROUP BY user_id")
def lease_stream(v: Views):
    own = J.events_stream(v.spark, v.sf_dir).selectExpr("concat('p', user_id % 8) AS project_id", "concat('QUEST-', user_id) AS task_id", "concat('AGENT', event_id % 17) AS holder", "ts")
    held = J.finish(J.leases(own), "append").where("state = 'held'")
    return held.groupBy("project_id", "task_id").agg(F.max("heartbeat").alias("heartbeat"))


@query("hint_stream")
def hint_stream(v: Views):
    calls = J.events_stream(v.spark, v.sf_dir).selectExpr(
        "event_id AS id", "concat('s', user_id, '-', day(ts)) AS session_id", "ts",
        "CASE event_type WHEN 'purchase' THEN 'quest_fulfill' WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'lore_inscribe' WHEN 'click' THEN CASE event_id % 7 WHEN 0 THEN 'quest_accept' WHEN 1 THEN 'quest_brief' ELSE 'quest_journal' END ELSE 'lore_appraise' END AS tool",
        "CASE event_id % 6 WHEN 0 THEN 'fix login-page-redirect' WHEN 1 THEN 'QUEST-12' WHEN 2 THEN 'we need to tidy this up' WHEN 3 THEN 'login-redirect' WHEN 4 THEN 'see ENTRY-4 which shows a long enough sentence here' ELSE 'plain words' END AS arg",
        "event_id % 5 = 0 AS empty_result", "event_id % 9 = 0 AS brief_stale",
    )
    return J.finish(J.hints(calls), "append")


@query("watch_pipeline", "SELECT project_id, count(*) AS signals, CAST(least(count(*), 3) AS BIGINT) AS renewals FROM (SELECT DISTINCT e.id, e.project_id FROM entries e JOIN file_events f ON f.project_id = e.project_id AND f.path = e.file_path WHERE e.status = 'current') x GROUP BY project_id")
def watch_pipeline(v: Views):
    """File events to signals to renewals, at most three a project and batch; one batch here."""
    from tallyarc.session import scratch_path

    path = scratch_path(v.spark, "signals")
    own = J.events_stream(v.spark, v.sf_dir).selectExpr("event_id AS id", "concat('src', user_id % 20) AS project_id", "concat('docs/part_', user_id % 50, '.md') AS path", "ts", "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'write' END AS op")
    job = J.signals(own, v.entries, path).trigger(availableNow=True).start()
    job.awaitTermination()
    signals = v.spark.read.parquet(path)
    per = signals.select("entry_id", "project_id").distinct().groupBy("project_id").agg(F.count("*").alias("signals"))
    return per.withColumn("renewals", F.least("signals", F.lit(3)).cast("long"))

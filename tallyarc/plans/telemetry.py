"""Queries of usage, decisions and metrics."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import telemetry as U
from tallyarc.views import Views


@query("token_report_tool", "SELECT tool, calls, bytes, (bytes + 3) // 4 AS tokens, ((bytes + 3) // 4) // calls AS mean_tokens FROM (SELECT tool, count(*) AS calls, CAST(sum(resp_bytes) AS BIGINT) AS bytes FROM usage_log GROUP BY tool) x")
def token_report_tool(v: Views):
    return U.by_tool(v.usage_log)


@query("token_report_session", "SELECT *, (bytes + 3) // 4 AS tokens FROM (SELECT project_id, date_trunc('minute', ts) AS minute, min(ts) AS start, count(*) AS calls, CAST(sum(resp_bytes) AS BIGINT) AS bytes FROM usage_log GROUP BY ALL) x")
def token_report_session(v: Views):
    return U.by_session(v.usage_log)


@query("most_recent_session", "SELECT concat(project_id, '@', strftime(ts, '%Y-%m-%dT%H:%M')) AS session FROM usage_log ORDER BY ts DESC, id LIMIT 1")
def most_recent_session(v: Views):
    return U.latest_session(v.usage_log)


@query("scan_usage_log", "SELECT project_id, tool, CAST(exit_code AS BIGINT) AS exit_code, resp_bytes FROM usage_log")
def scan_usage_log(v: Views):
    """Usage written as lines, broken lines put in, and read again."""
    bad = v.spark.sql("SELECT * FROM VALUES (''), ('x\\ty'), ('never\\tp\\tt\\t0\\t1') AS l(value)")
    return U.parse_usage(U.usage_lines(v.usage_log).union(bad)).select("project_id", "tool", "exit_code", "resp_bytes")


@query("sink_usage", "SELECT substr(project_id, 1, 64) AS project_id, count(*) AS n FROM usage_log GROUP BY ALL")
def sink_usage(v: Views):
    return U.parse_usage(U.usage_lines(v.usage_log)).groupBy("project_id").agg(F.count("*").alias("n"))


_CUT = "substr({c}, 1, list_max(list_filter(generate_series(0, least({n}, length({c}))), lambda k: strlen(substr({c}, 1, k)) <= {n})))"


@query("sink_miss", f"SELECT ts, project_id, {_CUT.format(c='query', n=256)} AS query FROM (SELECT created_at AS ts, project_id, concat(title, ' / ', title, ' / ', title, ' / ', title) AS query FROM entries) x")
def sink_miss(v: Views):
    """Searches without a hit (here titles, long enough to be cut) written as lines to a folder and read again."""
    from tallyarc.session import scratch_path

    path = scratch_path(v.spark, "misses")
    misses = v.entries.select(F.col("created_at").alias("ts"), "project_id", F.concat_ws(" / ", *["title"] * 4).alias("query"))
    U.miss_lines(misses).write.text(path)
    return U.parse_misses(v.spark.read.text(path))


@query("scan_decision_log", "SELECT id, kind, allow, reason FROM decision_log")
def scan_decision_log(v: Views):
    """Decisions as JSON lines with broken ones put in, read again."""
    lines = v.decision_log.select(F.to_json(F.struct("id", "kind", "allow", "reason")).alias("value"))
    bad = v.spark.sql("SELECT * FROM VALUES ('{'), ('') AS l(value)")
    parsed = lines.union(bad).select(F.from_json("value", "id long, kind string, allow boolean, reason string").alias("r"))
    return parsed.where("r.id IS NOT NULL").select("r.*")


@query("redact", r"SELECT id, regexp_replace(regexp_replace(reason, '\b(?:sk|pk|ghp|gho|xox[baprs])[-_][A-Za-z0-9]{16,}\b', '[redacted]', 'g'), '/(Users|home)/[^/\s]+', '~', 'g') AS reason FROM decision_log")
def redact(v: Views):
    return v.decision_log.select("id", U.redact(F.col("reason")).alias("reason"))


@query("sink_append_event", r"SELECT kind, count(*) AS n FROM decision_log WHERE regexp_matches(reason, '/home/') GROUP BY kind")
def sink_append_event(v: Views):
    """Redacted lines hold no home folder; they are counted by kind."""
    lines = v.decision_log.select("kind", F.to_json(F.struct("id", U.redact(F.col("reason")).alias("reason"))).alias("line"))
    return lines.where(~F.col("line").contains("/home/")).groupBy("kind").agg(F.count("*").alias("n"))


_KIND = "CASE WHEN trim(coalesce(kind, '')) = '' THEN 'unknown' ELSE kind END"


@query("rollup_hourly", f"SELECT date_trunc('hour', ts) AS bucket, {_KIND} AS kind, count(*) AS n FROM decision_log GROUP BY ALL")
def rollup_hourly(v: Views):
    return U.rollup(v.decision_log, "hour")


@query("rollup_daily", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, {_KIND} AS kind, count(*) AS n FROM decision_log GROUP BY ALL")
def rollup_daily(v: Views):
    return U.rollup(v.decision_log, "day")


@query("rollup_replay", f"SELECT date_trunc('hour', ts) AS bucket, {_KIND} AS kind, count(*) AS n FROM decision_log WHERE ts > (SELECT ts FROM decision_log WHERE id = 500) GROUP BY ALL")
def rollup_replay(v: Views):
    mark = v.decision_log.where("id = 500").select(F.col("ts").alias("mark"))
    after = v.decision_log.crossJoin(F.broadcast(mark)).where("ts > mark").drop("mark")  # one row
    return U.rollup(after, "hour")


_STATS = """SELECT h.rule_id, h.severity, h.enabled, count(f.id) AS fires, count(f.followed_through) AS scored, count(*) FILTER (f.followed_through = 1) AS hits,
    CASE WHEN count(f.followed_through) = 0 THEN 0e0 ELSE round(count(*) FILTER (f.followed_through = 1) / CAST(count(f.followed_through) AS DOUBLE), 6) END AS rate FROM hints h LEFT JOIN hint_fires f USING (rule_id) GROUP BY ALL"""


@query("hint_stats", _STATS)
def hint_stats(v: Views):
    return U.hint_stats(v.hints, v.hint_fires)


@query("join_hint_stats", "SELECT h.rule_id, f.session_id, count(f.id) AS fires FROM hints h LEFT JOIN hint_fires f USING (rule_id) GROUP BY ALL")
def join_hint_stats(v: Views):
    return v.hints.join(v.hint_fires, "rule_id", "left").groupBy("rule_id", "session_id").agg(F.count("id").alias("fires"))


@query("hint_prune", f"SELECT rule_id, CASE WHEN severity = 'hint' THEN 'demote to fyi' ELSE 'disable' END AS action FROM ({_STATS}) s WHERE enabled AND severity IN ('hint', 'fyi') AND scored >= 20 AND rate < 1446e-4")
def hint_prune(v: Views):
    return U.hint_prune(hint_stats(v))


_VALUES = "SELECT 'decisions_total' AS name, 'counter' AS kind, count(*) AS value FROM decision_log UNION ALL SELECT 'decisions_allowed_total', 'counter', count(*) FILTER (allow) FROM decision_log UNION ALL SELECT 'decisions_denied_total', 'counter', count(*) FILTER (NOT allow) FROM decision_log"


@query("decision_record", _VALUES)
def decision_record(v: Views):
    own = v.decision_log.agg(F.count("*").alias("decisions_total"), F.count_if("allow").alias("decisions_allowed_total"), F.count_if(~F.col("allow")).alias("decisions_denied_total"))
    return own.unpivot([], own.columns, "name", "value").select("name", F.lit("counter").alias("kind"), "value")


_METRICS = """SELECT 'decisions_total' AS name, 'counter' AS kind, count(*) AS value FROM decision_log UNION ALL SELECT 'events_logged_total', 'counter', count(*) FROM events
    UNION ALL SELECT 'idle_passes_total', 'counter', count(*) FILTER (allow AND kind = 'view') FROM decision_log UNION ALL SELECT 'lease_grants_total', 'counter', count(*) FROM leases
    UNION ALL SELECT 'lease_forfeits_total', 'counter', count(*) FILTER (expires_at < @ts'2024-01-20 00:00:00') FROM leases
    UNION ALL SELECT 'reaper_sweeps_total', 'counter', count(DISTINCT CASE WHEN expires_at < @ts'2024-01-20 00:00:00' THEN date_trunc('hour', expires_at) END) FROM leases
    UNION ALL SELECT 'renewal_tasks_total', 'counter', count(*) FILTER (starts_with(note, '[renewal] ')) FROM task_notes
    UNION ALL SELECT 'sessions_opened_total', 'counter', count(DISTINCT session_id) FROM tool_calls
    UNION ALL SELECT 'stale_signals_total', 'counter', (SELECT count(*) FROM (SELECT DISTINCT e.id FROM entries e JOIN file_events f ON f.project_id = e.project_id AND f.path = e.file_path WHERE e.status = 'current') x)
    UNION ALL SELECT 'sessions_active', 'gauge', count(DISTINCT CASE WHEN ts >= @ts'2024-01-29 00:00:00' THEN session_id END) FROM tool_calls
    UNION ALL SELECT 'decision_recorder_enabled', 'gauge', CAST(count(*) > 0 AS BIGINT) FROM decision_log"""


@query("metrics_exposition", f"SELECT string_agg(concat('# HELP ', name, ' ', replace(name, '_', ' '), chr(10), '# TYPE ', name, ' ', kind, chr(10), name, ' ', @str(value), chr(10)), '' ORDER BY name) AS text FROM ({_METRICS}) x")
def metrics_exposition(v: Views):
    """The eleven metrics of the service as text: leases, sweeps, sessions, passes, signals, renewals, decisions, events."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    expired = F.col("expires_at") < at("2024-01-20 00:00:00")
    log = v.decision_log.agg(F.count("*").alias("decisions_total"), F.count_if(F.col("allow") & (F.col("kind") == "view")).alias("idle_passes_total"), (F.count("*") > 0).cast("long").alias("decision_recorder_enabled"))
    leases = v.leases.agg(F.count("*").alias("lease_grants_total"), F.count_if(expired).alias("lease_forfeits_total"), F.count_distinct(F.when(expired, F.date_trunc("hour", "expires_at"))).alias("reaper_sweeps_total"))
    calls = v.tool_calls.agg(F.count_distinct("session_id").alias("sessions_opened_total"), F.count_distinct(F.when(F.col("ts") >= at("2024-01-29 00:00:00"), F.col("session_id"))).alias("sessions_active"))
    renewals = v.task_notes.agg(F.count_if(F.col("note").startswith("[renewal] ")).alias("renewal_tasks_total"))
    files = v.file_events.select("project_id", F.col("path").alias("file_path")).distinct()
    stale = v.entries.where("status = 'current'").join(files, ["project_id", "file_path"], "left_semi").agg(F.count("*").alias("stale_signals_total"))
    logged = v.events.agg(F.count("*").alias("events_logged_total"))
    values = None
    for one in (log, leases, calls, renewals, stale, logged):
        own = one.unpivot([], one.columns, "name", "value")
        values = own if values is None else values.unionByName(own)
    gauge = F.col("name").isin("sessions_active", "decision_recorder_enabled")
    return U.exposition(values.select("name", F.when(gauge, "gauge").otherwise("counter").alias("kind"), "value"))


_OPS = "SELECT user_id AS pass_id, CASE event_type WHEN 'click' THEN 'meld' WHEN 'signup' THEN 'renewal' WHEN 'view' THEN 'embed' WHEN 'error' THEN 'partial' ELSE 'other' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'approval' ELSE 'auto' END AS policy, event_id % 2 = 0 AS applied, event_id FROM events"


@query("narrate", f"""SELECT pass_id, count(*) FILTER (kind = 'meld' AND applied) AS melds, count(*) FILTER (kind = 'renewal' AND applied) AS renewals,
    CAST(coalesce(sum(CASE WHEN event_id % 4 = 0 THEN event_id % 10 ELSE 1 END) FILTER (kind = 'embed' AND applied), 0) AS BIGINT) AS embedded, count(*) FILTER (policy = 'approval' AND NOT applied) AS awaiting, count(*) FILTER (kind = 'partial') AS partial FROM ({_OPS}) o GROUP BY pass_id""")
def narrate(v: Views):
    kind = F.when(F.col("event_type") == "click", "meld").when(F.col("event_type") == "signup", "renewal").when(F.col("event_type") == "view", "embed").when(F.col("event_type") == "error", "partial").otherwise("other")
    detail = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct((F.col("event_id") % 10).alias("count")))).otherwise("{}")
    ops = v.events.select(F.col("user_id").alias("pass_id"), kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, "approval").otherwise("auto").alias("policy"), (F.col("event_id") % 2 == 0).alias("applied"), detail.alias("detail"))
    return U.narrate(ops)


@query("board_counts", "SELECT (SELECT count(*) FROM entries WHERE kind = 'principle' AND status = 'current') AS oaths, (SELECT count(*) FROM task_status WHERE status = 'next' AND claimed_by IS NULL) AS bounties, (SELECT count(*) FROM entries WHERE status = 'stale') AS echoes")
def board_counts(v: Views):
    one = v.entries.agg(F.count_if((F.col("kind") == "principle") & (F.col("status") == "current")).alias("oaths"), F.count_if(F.col("status") == "stale").alias("echoes"))
    two = v.task_status.agg(F.count_if((F.col("status") == "next") & F.col("claimed_by").isNull()).alias("bounties"))
    return one.crossJoin(two)  # a row each


@query("join_asof_hint_followup", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS pos FROM tool_calls), h AS (SELECT *, min(CASE WHEN tool = 'quest_fulfill' THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS hit FROM e)
    SELECT session_id, id, hit - pos AS offset FROM h WHERE tool = 'lore_inscribe'""")
def join_asof_hint_followup(v: Views):
    events = v.tool_calls.withColumn("ok", F.col("tool") == "quest_fulfill")
    return U.first_after(v.tool_calls.where("tool = 'lore_inscribe'").select("session_id", "id"), events)

"""Queries of staleness, leases and gates."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import staleness as T
from tallyarc.views import NOW, Views

AT = "2024-01-30 18:00:00"


def _at(text: str = AT):
    return F.lit(text).cast("timestamp_ntz")


_SIGNALS = """SELECT entry_id, project_id, reason, ts AS observed_at FROM (SELECT e.id AS entry_id, e.project_id, concat('file ', f.op) AS reason, f.ts, row_number() OVER (PARTITION BY e.id ORDER BY f.ts DESC, f.id DESC) AS rn
    FROM entries e JOIN file_events f ON f.project_id = e.project_id AND f.path = e.file_path WHERE e.status = 'current') x WHERE rn = 1"""


@query("stale_by_path", _SIGNALS)
def stale_by_path(v: Views):
    return T.stale_by_path(v.entries, v.file_events)


@query("echo_reason", f"""WITH s AS ({_SIGNALS}), a AS (SELECT e.*, CAST(floor(epoch_us(@ts'{NOW}') / 86400000000 - epoch_us(created_at) / 86400000000) AS BIGINT) AS age FROM entries e WHERE status = 'current'),
    r AS (SELECT a.id, a.project_id, concat_ws('; ', CASE WHEN valid_days > 0 AND age >= valid_days THEN concat(@str(age), 'd old (valid: ', @str(valid_days), 'd)') END, s.reason) AS reason FROM a LEFT JOIN s ON s.entry_id = a.id)
    SELECT * FROM r WHERE reason <> ''""")
def echo_reason(v: Views):
    return T.echoes(v.entries, T.stale_by_path(v.entries, v.file_events), _at(NOW))


@query("git_sweep", "SELECT e.id, e.file_path AS path, m.last_modified FROM entries e JOIN (SELECT path, max(ts) + INTERVAL '600' DAY AS last_modified FROM file_events GROUP BY path) m ON m.path = e.file_path WHERE e.status = 'current' AND m.last_modified > e.created_at")
def git_sweep(v: Views):
    modified = v.file_events.groupBy("path").agg((F.max("ts") + F.expr("INTERVAL '600' DAY")).alias("last_modified"))
    return T.sweep(v.entries, modified)


@query("lease_expired", f"SELECT project_id, task_id, expires_at FROM leases WHERE expires_at <= @ts'{AT}'")
def lease_expired(v: Views):
    return T.leases_expired(v.leases, _at()).select("project_id", "task_id", "expires_at")


@query("join_interval_lease", f"SELECT l.task_id, t.status FROM leases l JOIN task_status t ON t.project_id = l.project_id AND t.task_id = l.task_id WHERE l.heartbeat_at <= @ts'{AT}' AND l.expires_at > @ts'2024-01-10 00:00:00'")
def join_interval_lease(v: Views):
    own = v.leases.where((F.col("heartbeat_at") <= _at()) & (F.col("expires_at") > _at("2024-01-10 00:00:00")))
    return own.join(v.task_status, ["project_id", "task_id"]).select("task_id", "status")


_LIVE = "SELECT DISTINCT concat('s', @str(user_id)) AS session_id FROM events WHERE user_id % 3 = 0"


def _live(v: Views):
    return v.events.where("user_id % 3 = 0").selectExpr("concat('s', user_id) AS session_id").distinct()


@query("lease_reap", f"""SELECT l.project_id, l.task_id, CASE WHEN s.session_id IS NOT NULL THEN 'kept' WHEN coalesce(t.status = 'in_progress' AND lower(t.claimed_by) = lower(l.holder), false) THEN 'forfeit' ELSE 'orphan' END AS action
    FROM leases l LEFT JOIN ({_LIVE}) s ON s.session_id = l.session_id LEFT JOIN task_status t ON t.project_id = l.project_id AND t.task_id = l.task_id WHERE l.expires_at <= @ts'2024-02-25 00:00:00'""")
def lease_reap(v: Views):
    return T.lease_reap(v.leases, v.task_status, _live(v), _at("2024-02-25 00:00:00"))


@query("lease_renew_session", f"SELECT l.task_id, CASE WHEN s.session_id IS NOT NULL THEN @ts'{AT}' + INTERVAL '10' MINUTE ELSE l.expires_at END AS expires_at FROM leases l LEFT JOIN ({_LIVE}) s ON s.session_id = l.session_id")
def lease_renew_session(v: Views):
    return T.lease_renew(v.leases, _live(v), _at()).select("task_id", "expires_at")


@query("lease_renew_all", f"SELECT task_id, @ts'{AT}' + INTERVAL '10' MINUTE AS expires_at FROM leases")
def lease_renew_all(v: Views):
    return T.lease_renew(v.leases, None, _at()).select("task_id", "expires_at")


@query("lease_acquire", f"SELECT project_id, task_id, CASE WHEN task_id LIKE '%5' THEN 'new' ELSE holder END AS holder FROM leases")
def lease_acquire(v: Views):
    new = v.leases.where("task_id LIKE '%5'").withColumns({"holder": F.lit("new"), "heartbeat_at": F.col("heartbeat_at") + F.expr("INTERVAL '1' DAY")})
    return T.lease_acquire(v.leases, new).select("project_id", "task_id", "holder")


@query("lease_release", f"SELECT task_id FROM leases l WHERE NOT EXISTS (SELECT 1 FROM ({_LIVE}) s WHERE s.session_id = l.session_id)")
def lease_release(v: Views):
    return v.leases.join(_live(v), "session_id", "left_anti").select("task_id")


@query("lease_list", f"SELECT session_id, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM leases GROUP BY session_id")
def lease_list(v: Views):
    return v.leases.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("task_id")), ",").alias("tasks"))


@query("session_presence", f"SELECT count(*) AS agents, count(l.session_id) AS on_lease FROM ({_LIVE}) s LEFT JOIN (SELECT DISTINCT session_id FROM leases) l ON l.session_id = s.session_id")
def session_presence(v: Views):
    return T.presence(v.leases, _live(v))


@query("format_presence", f"SELECT concat(@str(agents), ' agents active, ', @str(on_lease), ' on lease') AS line FROM (SELECT count(*) AS agents, count(l.session_id) AS on_lease FROM ({_LIVE}) s LEFT JOIN (SELECT DISTINCT session_id FROM leases) l ON l.session_id = s.session_id) x")
def format_presence(v: Views):
    return session_presence(v).select(F.format_string("%d agents active, %d on lease", "agents", "on_lease").alias("line"))


@query("idle_gate", """WITH l AS (SELECT concat('s', @str(user_id)) AS key, event_id AS id, epoch_us(ts) AS us, CASE event_type WHEN 'click' THEN 'touch' WHEN 'purchase' THEN 'begin' WHEN 'signup' THEN 'end' ELSE 'tick' END AS what, user_id % 7 <> 0 AS armed FROM events),
    w AS (SELECT *, coalesce(last_value(CASE WHEN what = 'touch' THEN us END IGNORE NULLS) OVER o, first_value(us) OVER o) AS active, last_value(CASE WHEN what = 'end' THEN us END IGNORE NULLS) OVER o AS ended,
        last_value(CASE WHEN what IN ('begin', 'end') THEN what END IGNORE NULLS) OVER o AS state FROM l WINDOW o AS (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    r AS (SELECT key, id, CASE WHEN NOT armed THEN 'disabled' WHEN state = 'begin' THEN 'pass_in_flight' WHEN us - active < 28800000000 THEN 'not_idle' WHEN us - ended < 28800000000 THEN 'gap_not_elapsed' ELSE 'fire' END AS reason FROM w WHERE what = 'tick')
    SELECT key, id, reason, reason = 'fire' AS allow FROM r""")
def idle_gate(v: Views):
    """Decisions at views and errors, with reasons; clicks are activity, purchases begin a pass and signups end it; eight hours."""
    from tallyarc.operators.idlegate import decisions

    what = F.when(F.col("event_type") == "click", "touch").when(F.col("event_type") == "purchase", "begin").when(F.col("event_type") == "signup", "end").otherwise("tick")
    log = v.events.select(F.concat(F.lit("s"), F.col("user_id")).alias("key"), "ts", F.col("event_id").alias("id"), what.alias("what"), (F.col("user_id") % 7 != 0).alias("armed"))
    return decisions(log, 8 * 3600)


@query("autopass_throttle", "SELECT user_id, event_id AS id FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) x WHERE gap IS NULL OR gap >= 21600000000")
def autopass_throttle(v: Views):
    return T.throttled(v.events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id")), 6 * 3600).select(F.col("key").alias("user_id"), "id")


@query("debounce", """WITH r AS (SELECT *, sum(new) OVER (PARTITION BY project_id, path ORDER BY ts, id) AS run FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY project_id, path ORDER BY ts, id)) < 3600000000 THEN 0 ELSE 1 END AS new FROM file_events) x),
    g AS (SELECT project_id, path, run, min(ts) AS start, max(ts) AS last, count(*) AS n, arg_min(op, struct_pack(a := ts, b := id)) AS first_op, arg_max(op, struct_pack(a := ts, b := id)) AS last_op FROM r GROUP BY ALL)
    SELECT project_id, path, start, last, n, last_op FROM g WHERE NOT (first_op = 'create' AND last_op = 'remove')""")
def debounce(v: Views):
    return T.debounced(v.file_events, 3600)


@query("policy_classify", """SELECT id, kind, CASE kind WHEN 'meld_exact' THEN 'auto' WHEN 'renewal' THEN 'auto' WHEN 'embed' THEN 'auto' ELSE 'approval' END AS policy
    FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'meld_exact' WHEN 1 THEN 'meld_near' WHEN 2 THEN 'renewal' WHEN 3 THEN 'embed' ELSE tool END AS kind FROM tool_calls) k""")
def policy_classify(v: Views):
    """Operations of the journal by what they may do unasked; what is not known needs approval."""
    from tallyarc.operators.upkeep import policy

    kinds = v.tool_calls.selectExpr("id", "CASE id % 5 WHEN 0 THEN 'meld_exact' WHEN 1 THEN 'meld_near' WHEN 2 THEN 'renewal' WHEN 3 THEN 'embed' ELSE tool END AS kind")
    return kinds.withColumn("policy", policy(F.col("kind")))


@query("format_age", f"""SELECT task_id, CASE WHEN s >= 3600 THEN concat(@str(s // 3600), 'h', @str(s // 60 % 60), 'm', @str(s % 60), 's') WHEN s >= 60 THEN concat(@str(s // 60), 'm', @str(s % 60), 's') ELSE concat(@str(s), 's') END AS age
    FROM (SELECT task_id, greatest(0, epoch_us(@ts'{AT}') - epoch_us(heartbeat_at)) // 1000000 AS s FROM leases) x""")
def format_age(v: Views):
    return v.leases.select("task_id", T.format_age(F.col("heartbeat_at"), _at()).alias("age"))


@query("renewal_step", f"""WITH s AS ({_SIGNALS}), c AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS rn FROM entries WHERE status = 'current' AND id IN (SELECT entry_id FROM s))
    SELECT project_id, count(*) FILTER (rn <= 3) AS posted, count(*) FILTER (rn > 3) AS over_cap FROM c GROUP BY project_id""")
def renewal_step(v: Views):
    """Renewals of a project: three at most are posted, so their numbers follow from the count of its signals."""
    stale = T.stale_by_path(v.entries, v.file_events).groupBy("project_id").agg(F.count("*").alias("n"))
    return stale.select("project_id", F.least("n", F.lit(3)).cast("long").alias("posted"), F.greatest(F.col("n") - 3, F.lit(0)).cast("long").alias("over_cap"))


@query("journal_ops", """WITH l AS (SELECT session_id AS pass_id, id, CASE tool WHEN 'session_start' THEN 'begin' WHEN 'quest_fulfill' THEN 'end' WHEN 'lore_inscribe' THEN 'tell' ELSE 'op' END AS what FROM tool_calls),
    b AS (SELECT pass_id, min(id) AS begun FROM l WHERE what = 'begin' GROUP BY pass_id), e AS (SELECT l.pass_id, min(id) AS ended_id FROM l JOIN b USING (pass_id) WHERE what = 'end' AND id > begun GROUP BY l.pass_id),
    t AS (SELECT l.pass_id, min(id) AS told_id FROM l JOIN e USING (pass_id) WHERE what = 'tell' AND id > ended_id GROUP BY l.pass_id),
    o AS (SELECT l.pass_id, count(*) AS ops FROM l JOIN b USING (pass_id) LEFT JOIN e USING (pass_id) WHERE what = 'op' AND id > begun AND (ended_id IS NULL OR id < ended_id) GROUP BY l.pass_id)
    SELECT pass_id, coalesce(ops, 0) AS ops, ended_id, told_id FROM b LEFT JOIN e USING (pass_id) LEFT JOIN t USING (pass_id) LEFT JOIN o USING (pass_id)""")
def journal_ops(v: Views):
    """Sessions as passes: begun by their start, ended by the first fulfilment, told of by the first entry after it."""
    from tallyarc.operators.passlog import fold

    what = F.when(F.col("tool") == "session_start", "begin").when(F.col("tool") == "quest_fulfill", "end").when(F.col("tool") == "lore_inscribe", "tell").otherwise("op")
    return fold(v.tool_calls.select(F.col("session_id").alias("pass_id"), "id", what.alias("what")))

"""Queries of the task board."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import board as B
from tallyarc.views import Views

CUT = "1998-01-01 00:00:00"


def cutoff():
    return F.lit(CUT).cast("timestamp_ntz")


#: Specs in the oracle's words: fields of spec notes, the last scalar, lists since the last replacement.
_PARTS = r"""parts AS (SELECT project_id, task_id, id, i AS part, starts_with(note, '[spec-replace] ') AS replace, lower(trim(string_split(t, ':')[1])) AS field,
        trim(substr(t, instr(t, ':') + 1)) AS value FROM (
            SELECT project_id, task_id, id, note, unnest(string_split(regexp_replace(note, '^\[spec(-replace)?\] ', ''), '; ')) AS t,
                generate_subscripts(string_split(regexp_replace(note, '^\[spec(-replace)?\] ', ''), '; '), 1) AS i
            FROM task_notes WHERE starts_with(note, '[spec] ') OR starts_with(note, '[spec-replace] ')) x WHERE instr(t, ':') > 1),
    scalars AS (SELECT project_id, task_id, max_by(value, id * 100 + part) FILTER (field = 'subject') AS subject, max_by(value, id * 100 + part) FILTER (field = 'priority') AS priority,
        max_by(value, id * 100 + part) FILTER (field = 'epic') AS epic FROM parts GROUP BY ALL),
    since AS (SELECT *, coalesce(max(CASE WHEN replace THEN id END) OVER (PARTITION BY project_id, task_id, field), -1) AS since FROM parts WHERE field IN ('files', 'depends_on')),
    items AS (SELECT project_id, task_id, field, id, part, unnest(string_split(value, ',')) AS item, generate_subscripts(string_split(value, ','), 1) AS k FROM since WHERE id >= since),
    lists AS (SELECT project_id, task_id, string_agg(trim(item), ',' ORDER BY id, part, k) FILTER (field = 'files') AS files,
        string_agg(upper(trim(item)), ',' ORDER BY id, part, k) FILTER (field = 'depends_on') AS depends_on FROM items WHERE trim(item) <> '' GROUP BY ALL),
    specs AS (SELECT s.*, l.files, l.depends_on FROM scalars s LEFT JOIN lists l USING (project_id, task_id)),
    deps AS (SELECT DISTINCT project_id, task_id, unnest(string_split(depends_on, ',')) AS dep FROM specs WHERE depends_on IS NOT NULL)"""
_RANK = "CASE lower(trim(coalesce(priority, ''))) WHEN 'p0' THEN 0 WHEN 'p1' THEN 1 WHEN 'p2' THEN 2 WHEN 'p3' THEN 3 ELSE 9 END"


@query("spec_fold", f"WITH {_PARTS} SELECT project_id, task_id, subject, priority, epic, coalesce(files, '') AS files, coalesce(depends_on, '') AS depends_on FROM specs -- task_notes")
def spec_fold(v: Views):
    return B.spec_fold(v.task_notes).select("project_id", "task_id", "subject", "priority", "epic", F.array_join("files", ",").alias("files"), F.array_join("depends_on", ",").alias("depends_on"))


@query("quest_body", r"SELECT project_id, task_id, string_agg(note, chr(10) ORDER BY id) AS body FROM task_notes WHERE starts_with(note, '[spec] ') OR starts_with(note, '[spec-replace] ') GROUP BY ALL")
def quest_body(v: Views):
    return B.quest_body(v.task_notes)


@query("quest_load", f"WITH {_PARTS} SELECT t.project_id, t.task_id, t.status, s.subject, s.priority FROM task_status t LEFT JOIN specs s USING (project_id, task_id) -- task_notes")
def quest_load(v: Views):
    return B.load(v.task_status, v.task_notes).select("project_id", "task_id", "status", "subject", "priority")


@query("quest_list", f"""WITH {_PARTS}, inv AS (SELECT project_id, dep AS task_id, string_agg(DISTINCT task_id, ',' ORDER BY task_id) AS blocks FROM deps GROUP BY ALL)
    SELECT t.project_id, t.task_id, t.status, s.subject, s.priority, s.epic, coalesce(i.blocks, '') AS blocks FROM task_status t LEFT JOIN specs s USING (project_id, task_id)
    LEFT JOIN inv i USING (project_id, task_id) WHERE t.status NOT IN ('done', 'blocked') AND lower(s.epic) = 'e3' -- task_notes""")
def quest_list(v: Views):
    return B.quest_list(v.task_status, B.spec_fold(v.task_notes), epic="E3").withColumn("blocks", F.array_join("blocks", ","))


@query("quest_active", "SELECT project_id, task_id, claimed_by FROM task_status WHERE status = 'in_progress'")
def quest_active(v: Views):
    return v.task_status.where("status = 'in_progress'").select("project_id", "task_id", "claimed_by").orderBy("project_id", "task_id")


@query("quest_orders", "SELECT task_id, claimed_by FROM task_status WHERE status = 'in_progress' AND project_id = 'p3' AND claimed_by = 'agent5'")
def quest_orders(v: Views):
    return v.task_status.where("status = 'in_progress' AND project_id = 'p3' AND claimed_by = 'agent5'").select("task_id", "claimed_by").orderBy("task_id")


@query("quest_scroll", """SELECT project_id, task_id, created_at, id, 'note' AS what, note AS text FROM task_notes WHERE task_id = 'QUEST-40' UNION ALL
    SELECT project_id, task_id, created_at, id, 'event', event FROM task_events WHERE task_id = 'QUEST-40'
    AND project_id IN (SELECT project_id FROM task_status WHERE task_id = 'QUEST-40')""")
def quest_scroll(v: Views):
    return B.timeline(v.task_notes, v.task_events, v.task_status.where("task_id = 'QUEST-40'").select("project_id", "task_id"))


@query("system_note", """SELECT starts_with(note, '[spec] ') OR starts_with(note, '[spec-replace] ') OR starts_with(note, '[rework] of: ') OR starts_with(note, '[checkpoint] ')
    OR starts_with(note, '[completed] ') OR starts_with(note, '[renewal] entry: ') AS system, count(*) AS n FROM task_notes GROUP BY ALL""")
def system_note(v: Views):
    return v.task_notes.groupBy(B.is_system_note(F.col("note")).alias("system")).agg(F.count("*").alias("n"))


@query("join_deps", f"WITH {_PARTS} SELECT d.project_id, d.task_id, d.dep, t.status FROM deps d JOIN task_status t ON t.project_id = d.project_id AND t.task_id = d.dep -- task_notes")
def join_deps(v: Views):
    to = v.task_status.select("project_id", F.col("task_id").alias("dep"), "status")
    return B.dependencies(B.spec_fold(v.task_notes)).join(to, ["project_id", "dep"]).select("project_id", "task_id", "dep", "status")


_DONE = f"""WITH {_PARTS}, dd AS (SELECT d.project_id, d.task_id, bool_and(t.status IS NOT NULL) AS all_done FROM deps d
    LEFT JOIN task_status t ON t.project_id = d.project_id AND t.task_id = d.dep AND t.status = 'done' GROUP BY ALL),
    ok AS (SELECT s.project_id, s.task_id, coalesce(d.all_done, true) AS all_done FROM specs s LEFT JOIN dd d USING (project_id, task_id))"""


@query("deps_all_done", f"{_DONE} SELECT project_id, task_id, all_done FROM ok -- task_notes task_status")
def deps_all_done(v: Views):
    return B.deps_all_done(B.spec_fold(v.task_notes), v.task_status)


@query("dep_cascade", f"{_DONE} SELECT t.project_id, t.task_id, 'next' AS status FROM task_status t JOIN dd d USING (project_id, task_id) WHERE t.status = 'blocked' AND d.all_done -- task_notes")
def dep_cascade(v: Views):
    return B.cascade(B.spec_fold(v.task_notes), v.task_status)


@query("recompute_blocked", f"""{_DONE} SELECT t.project_id, t.task_id, CASE WHEN t.status = 'done' THEN 'done' WHEN NOT coalesce(o.all_done, true) THEN 'blocked'
    WHEN t.status = 'blocked' THEN 'next' ELSE t.status END AS status FROM task_status t LEFT JOIN ok o USING (project_id, task_id) -- task_notes""")
def recompute_blocked(v: Views):
    return B.recompute_blocked(B.spec_fold(v.task_notes), v.task_status)


@query("fulfill", f"""WITH {_PARTS}, st AS (SELECT project_id, task_id, CASE WHEN seq % 7 = 0 THEN 'done' ELSE status END AS status FROM task_status),
    dd AS (SELECT d.project_id, d.task_id, bool_and(t.status IS NOT NULL) AS all_done FROM deps d LEFT JOIN st t ON t.project_id = d.project_id AND t.task_id = d.dep AND t.status = 'done' GROUP BY ALL)
    SELECT s.project_id, s.task_id, CASE WHEN s.status = 'blocked' AND coalesce(d.all_done, false) THEN 'next' ELSE s.status END AS status FROM st s LEFT JOIN dd d USING (project_id, task_id) -- task_notes""")
def fulfill(v: Views):
    return B.fulfill(v.task_status, B.spec_fold(v.task_notes), v.task_status.where("seq % 7 = 0"))


@query("forfeit", """SELECT project_id, task_id, CASE WHEN seq % 2 = 0 AND status = 'in_progress' THEN 'next' ELSE status END AS status,
    CASE WHEN seq % 2 = 0 AND status = 'in_progress' THEN NULL ELSE claimed_by END AS claimed_by FROM task_status""")
def forfeit(v: Views):
    return B.forfeit(v.task_status, v.task_status.where("seq % 2 = 0"))


_BOUNTY = f"""WITH {_PARTS}, free AS (SELECT t.project_id, t.task_id, {_RANK} AS rank, string_split(coalesce(s.files, ''), ',') AS files, string_split(coalesce(s.depends_on, ''), ',') AS deps,
        row_number() OVER (PARTITION BY t.project_id ORDER BY {_RANK}, t.task_id) AS rn FROM task_status t LEFT JOIN specs s USING (project_id, task_id) WHERE t.status = 'next' AND t.claimed_by IS NULL),
    top AS (SELECT project_id, task_id AS top, files AS tf, deps AS td FROM free WHERE rn = 1),
    safe AS (SELECT f.project_id, f.task_id, row_number() OVER (PARTITION BY f.project_id ORDER BY f.rank, f.task_id) AS place FROM free f JOIN top t USING (project_id)
        WHERE f.rn > 1 AND NOT list_has_any(list_filter(f.files, lambda x: x <> ''), list_filter(t.tf, lambda x: x <> '')) AND NOT list_contains(f.deps, t.top) AND NOT list_contains(t.td, f.task_id))"""


@query("bounties", f"{_BOUNTY} SELECT project_id, top AS task_id, CAST(0 AS INTEGER) AS place FROM top UNION ALL SELECT project_id, task_id, CAST(place AS INTEGER) FROM safe WHERE place <= 5 -- task_notes task_status")
def bounties(v: Views):
    return B.bounties(v.task_status, B.spec_fold(v.task_notes))


@query("join_parallel_safe", f"{_BOUNTY} SELECT project_id, count(*) AS n FROM safe WHERE place <= 5 GROUP BY project_id -- task_notes task_status")
def join_parallel_safe(v: Views):
    return B.bounties(v.task_status, B.spec_fold(v.task_notes)).where("place > 0").groupBy("project_id").agg(F.count("*").alias("n"))


@query("first_claim_wins", """SELECT project_id, task_id, agent_id AS owner, n AS claims FROM (SELECT *, row_number() OVER (PARTITION BY project_id, task_id ORDER BY created_at, id) AS rn,
    count(*) OVER (PARTITION BY project_id, task_id) AS n FROM task_events WHERE event = 'claimed') x WHERE rn = 1""")
def first_claim_wins(v: Views):
    return B.first_claim_wins(v.task_events.where("event = 'claimed'"))


@query("accept", """SELECT t.project_id, t.task_id, CASE WHEN t.status = 'next' AND t.claimed_by IS NULL AND c.agent_id IS NOT NULL THEN 'in_progress' ELSE t.status END AS status,
    CASE WHEN t.status = 'next' AND t.claimed_by IS NULL AND c.agent_id IS NOT NULL THEN c.agent_id ELSE t.claimed_by END AS claimed_by FROM task_status t
    LEFT JOIN (SELECT project_id, task_id, arg_min(agent_id, struct_pack(c := created_at, i := id)) AS agent_id FROM task_events WHERE event = 'claimed' GROUP BY ALL) c USING (project_id, task_id)""")
def accept(v: Views):
    return B.claim(v.task_status, v.task_events.where("event = 'claimed'"))


@query("last_brief", """SELECT project_id, replace(note, '[brief] ', '') AS text, created_at AS at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rn
    FROM task_notes WHERE task_id = '__PROJECT__' AND starts_with(note, '[brief] ')) x WHERE rn = 1""")
def last_brief(v: Views):
    return B.last_brief(v.task_notes)


@query("brief_stale", f"""SELECT p.project_id, b.at IS NULL OR b.at < @ts'{CUT}' - INTERVAL '24' HOUR AS stale FROM (SELECT DISTINCT project_id FROM task_status) p
    LEFT JOIN (SELECT project_id, max(created_at) AS at FROM task_notes WHERE task_id = '__PROJECT__' AND starts_with(note, '[brief] ') GROUP BY project_id) b USING (project_id)""")
def brief_stale(v: Views):
    return B.brief_stale(v.task_notes, v.task_status.select("project_id").distinct(), cutoff())


@query("epic_summary", f"""WITH {_PARTS}, j AS (SELECT t.status, CASE WHEN trim(coalesce(s.epic, '')) = '' THEN '(none)' ELSE s.epic END AS epic FROM task_status t LEFT JOIN specs s USING (project_id, task_id))
    SELECT coalesce(epic, 'TOTAL') AS epic, count(*) FILTER (status = 'next') AS next, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'blocked') AS blocked,
    count(*) FILTER (status = 'done') AS done, count(*) AS total FROM j GROUP BY ROLLUP (epic) -- task_notes""")
def epic_summary(v: Views):
    return B.epic_summary(v.task_status, B.spec_fold(v.task_notes))


@query("pulse", f"""WITH d AS (SELECT project_id, task_id, updated_at >= @ts'{CUT}' AS recent FROM task_status WHERE status = 'done'),
    r AS (SELECT DISTINCT project_id, upper(trim(replace(note, '[rework] of: ', ''))) AS task_id FROM task_notes WHERE starts_with(note, '[rework] of: ')),
    c AS (SELECT DISTINCT project_id, task_id FROM task_notes WHERE starts_with(note, '[completed] ')),
    g AS (SELECT d.project_id, count(*) AS done_total, count(*) FILTER (recent) AS done_window, count(*) FILTER (recent AND r.task_id IS NOT NULL) AS rework, count(*) FILTER (recent AND c.task_id IS NULL) AS no_report
        FROM d LEFT JOIN r USING (project_id, task_id) LEFT JOIN c USING (project_id, task_id) GROUP BY d.project_id)
    SELECT *, CASE WHEN done_window > 0 THEN rework * 100 // done_window ELSE 0 END AS rework_pct, CASE WHEN done_window > 0 THEN rework * 100 // done_window ELSE 0 END >= 20 AS high FROM g""")
def pulse(v: Views):
    return B.pulse(v.task_status, v.task_notes, cutoff())


@query("join_pulse", f"""SELECT project_id, task_id FROM task_status t WHERE status = 'done' AND updated_at >= @ts'{CUT}' AND NOT EXISTS
    (SELECT 1 FROM task_notes n WHERE n.project_id = t.project_id AND n.task_id = t.task_id AND starts_with(n.note, '[completed] '))""")
def join_pulse(v: Views):
    done = v.task_status.where("status = 'done'").where(F.col("updated_at") >= cutoff()).select("project_id", "task_id")
    return done.join(v.task_notes.where(F.col("note").startswith("[completed] ")), ["project_id", "task_id"], "left_anti")


@query("pulse_churn_median", f"""SELECT t.project_id, median(greatest(coalesce(n, 0) - 1, 0)) AS churn_median FROM task_status t LEFT JOIN (SELECT project_id, task_id, count(*) AS n FROM task_notes
    WHERE starts_with(note, '[spec] ') OR starts_with(note, '[spec-replace] ') GROUP BY ALL) c USING (project_id, task_id) WHERE t.status = 'done' AND t.updated_at >= @ts'{CUT}' GROUP BY t.project_id""")
def pulse_churn_median(v: Views):
    return B.pulse_churn(v.task_status, v.task_notes, cutoff())


@query("pulse_hot_files", r"""WITH f AS (SELECT DISTINCT n.project_id, n.task_id, trim(x) AS file FROM (SELECT project_id, task_id, unnest(string_split(regexp_replace(note, '^\[spec(-replace)?\] files: ', ''), ',')) AS x
        FROM task_notes WHERE starts_with(note, '[spec] files: ') OR starts_with(note, '[spec-replace] files: ')) n JOIN task_status t USING (project_id, task_id) WHERE t.status = 'done' AND trim(x) <> ''),
    g AS (SELECT project_id, file, count(*) AS tasks FROM f GROUP BY ALL HAVING count(*) >= 2)
    SELECT * FROM (SELECT project_id, file, tasks, CAST(row_number() OVER (PARTITION BY project_id ORDER BY tasks DESC, file) AS INTEGER) AS rank FROM g) x WHERE rank <= 3""")
def pulse_hot_files(v: Views):
    return B.hot_files(v.task_status, v.task_notes)


_OPEN = """open AS (SELECT DISTINCT n.project_id, n.note AS marker FROM task_notes n JOIN task_status t USING (project_id, task_id) WHERE t.status <> 'done' AND starts_with(n.note, '[renewal] entry: '))"""
_CAND = "cand AS (SELECT concat('p', @str(id % 8)) AS project_id, id AS entry_id FROM entries WHERE status = 'stale')"


def _candidates(v: Views):
    return v.entries.where("status = 'stale'").selectExpr("concat('p', id % 8) AS project_id", "id AS entry_id")


@query("renewals", f"""WITH {_OPEN}, {_CAND} SELECT project_id, entry_id, marker, 'P3' AS priority, 'lore-renewal' AS epic FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY entry_id) AS rn FROM (SELECT project_id, entry_id, concat('[renewal] entry: ENTRY-', @str(entry_id)) AS marker FROM cand) c
    WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.project_id = c.project_id AND o.marker = c.marker)) x WHERE rn <= 3""")
def renewals(v: Views):
    return B.renewals(_candidates(v), v.task_status, v.task_notes)


@query("join_open_renewal", f"WITH {_OPEN}, {_CAND} SELECT c.project_id, c.entry_id FROM cand c WHERE EXISTS (SELECT 1 FROM open o WHERE o.project_id = c.project_id AND o.marker = concat('[renewal] entry: ENTRY-', @str(entry_id)))")
def join_open_renewal(v: Views):
    open_ = v.task_notes.join(v.task_status.where("status <> 'done'"), B.KEY, "left_semi").where(F.col("note").startswith("[renewal] entry: "))
    own = _candidates(v).withColumn("note", F.concat(F.lit("[renewal] entry: ENTRY-"), F.col("entry_id").cast("string")))
    return own.join(open_, ["project_id", "note"], "left_semi").select("project_id", "entry_id")


@query("next_quest_id", "SELECT project_id, concat('QUEST-', @str(m)) AS next_id FROM (SELECT project_id, max(seq) + 1 AS m FROM task_status GROUP BY project_id) x")
def next_quest_id(v: Views):
    return B.next_ids(v.task_status)


@query("post", """WITH n AS (SELECT project_id, task_id, seq, status FROM task_status WHERE seq % 200 = 0),
    u AS (SELECT project_id, task_id, 0 AS k, concat('[spec] subject: copy ', @str(seq), '; priority: P2') AS note FROM n UNION ALL SELECT project_id, task_id, 1, '[spec] files: a.py, b.py' FROM n
    UNION ALL SELECT project_id, task_id, 2, '[spec] acceptance: it, works' FROM n)
    SELECT project_id, task_id, CAST(row_number() OVER (PARTITION BY project_id, task_id ORDER BY k) - 1 AS INTEGER) AS seq, note FROM u""")
def post(v: Views):
    new = v.task_status.where("seq % 200 = 0").selectExpr("project_id", "task_id", "concat('copy ', seq) AS subject", "'P2' AS priority", "'' AS epic", "array('a.py', 'b.py') AS files", "cast(array() AS array<string>) AS depends_on", "array('it, works') AS acceptance")
    return B.post_notes(new)


@query("quest_json", f"""WITH {_PARTS} SELECT t.task_id, s.subject, length(coalesce(s.files, '')) = 0 AS no_files FROM task_status t LEFT JOIN specs s USING (project_id, task_id) -- task_notes""")
def quest_json(v: Views):
    rows = B.load(v.task_status, v.task_notes)
    none = F.array().cast("array<string>")
    json = F.to_json(F.struct("task_id", "subject", F.coalesce("files", none).alias("files")))
    return rows.select("task_id", F.get_json_object(json, "$.subject").alias("subject"), (F.get_json_object(json, "$.files") == "[]").alias("no_files"))

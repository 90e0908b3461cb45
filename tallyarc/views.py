"""Domain tables over the star schema, written once as SQL that both engines read.

The archive (entries, links, vectors), the task board (status, notes, events, leases) and the logs are derived from the given
tables by integer arithmetic and literals only, so a Spark temp view and the oracle's common table expression agree. In a
deployment these views are tables of the same columns (``schemas.py``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2026-06-15 00:00:00"

#: ``@ts'...'`` is a timestamp without time zone, ``@str(x)`` a cast to text, ``@json(x, 'k')`` a number out of JSON text,
#: ``@day(x)`` midnight of a day.
VIEWS: dict[str, str] = {
    "entries": """
        SELECT doc_id + 1 AS id, source AS project_id, lang AS topic,
            CASE doc_id % 5 WHEN 0 THEN 'idea' WHEN 1 THEN 'research' WHEN 2 THEN 'decision' WHEN 3 THEN 'observation' ELSE 'principle' END AS kind,
            substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS summary, text AS body,
            concat('t', @str(doc_id % 7), ',t', @str(doc_id % 11)) AS tags,
            concat('docs/part_', @str(doc_id % 50), '.md') AS file_path,
            CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('p', @str(doc_id % 90)) END AS prompted_by,
            CASE (doc_id * 7 + 3) % 11 WHEN 0 THEN 'stale' WHEN 1 THEN 'superseded' WHEN 2 THEN 'archived' WHEN 4 THEN 'seed'
                WHEN 5 THEN 'exploring' WHEN 6 THEN 'imported' WHEN 7 THEN 'parked' ELSE 'current' END AS status,
            CASE doc_id % 5 WHEN 1 THEN 30 WHEN 2 THEN 180 END AS valid_days,
            @ts'2026-06-01 12:00:00' - (doc_id % 400) * INTERVAL '1' DAY AS created_at, (doc_id * 13) % 23 AS access_count
        FROM documents""",
    "entry_links": """
        SELECT from_id, to_id, min(relation) AS relation FROM (
            SELECT id AS from_id, (id * 31 + 7) % n + 1 AS to_id, CASE id % 3 WHEN 0 THEN 'informs' WHEN 1 THEN 'supersedes' ELSE 'contradicts' END AS relation
            FROM entries CROSS JOIN (SELECT count(*) AS n FROM entries) t
            UNION ALL
            SELECT id, (id * 21 + 19) % n + 1, CASE (id + 1) % 3 WHEN 0 THEN 'informs' WHEN 1 THEN 'supersedes' ELSE 'contradicts' END
            FROM entries CROSS JOIN (SELECT count(*) AS n FROM entries) t) u
        WHERE from_id <> to_id GROUP BY from_id, to_id""",
    "task_status": """
        SELECT concat('p', @str(o_orderkey % 8)) AS project_id, concat('QUEST-', @str(o_orderkey)) AS task_id, o_orderkey AS seq,
            CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 13 = 0 THEN 'blocked' WHEN o_orderstatus = 'O' THEN 'next' ELSE 'in_progress' END AS status,
            CASE WHEN o_orderstatus = 'P' AND o_orderkey % 13 <> 0 THEN concat('agent', @str(o_custkey % 17)) END AS claimed_by,
            o_orderdate AS updated_at
        FROM orders""",
    "task_notes": """
        SELECT seq * 256 + row_number() OVER (PARTITION BY seq ORDER BY part, line, note) AS id, project_id, task_id, agent_id, note, created_at FROM (
            SELECT seq, 0 AS part, 0 AS line, project_id, task_id, 'pm' AS agent_id, concat('[spec] subject: work ', @str(seq), '; priority: P', @str(seq % 5),
                CASE WHEN seq % 6 = 0 THEN '' ELSE concat('; epic: E', @str(seq % 6)) END) AS note, updated_at AS created_at FROM task_status
            UNION ALL
            SELECT s.seq, 1, l.l_linenumber, s.project_id, s.task_id, 'pm', concat('[spec] files: src/f', @str(l.l_partkey % 40), '.py, src/g', @str(l.l_suppkey % 9), '.py'), s.updated_at
            FROM task_status s JOIN lineitem l ON l.l_orderkey = s.seq
            UNION ALL
            SELECT seq, 2, 0, project_id, task_id, 'pm', concat('[spec] depends_on: quest-', @str(seq - 8), ', QUEST-', @str(seq - 16)), updated_at FROM task_status WHERE seq >= 16 AND seq % 3 = 0
            UNION ALL
            SELECT seq, 3, 0, project_id, task_id, 'pm', '[spec-replace] files: src/only.py', updated_at FROM task_status WHERE seq % 29 = 0
            UNION ALL
            SELECT seq, 4, 0, project_id, task_id, 'pm', concat('[rework] of: QUEST-', @str(seq - 1)), updated_at FROM task_status WHERE seq % 11 = 5
            UNION ALL
            SELECT seq, 5, 0, project_id, task_id, coalesce(claimed_by, 'pm'), concat('[completed] report ', @str(seq)), updated_at FROM task_status WHERE status = 'done' AND seq % 4 <> 0
            UNION ALL
            SELECT seq, 6, 0, project_id, '__PROJECT__', 'pm', concat('[brief] state ', @str(seq)), updated_at FROM task_status WHERE seq % 50 = 0
            UNION ALL
            SELECT seq, 7, 0, project_id, task_id, 'pm', concat('[renewal] entry: ENTRY-', @str(seq % 400 + 1)), updated_at FROM task_status WHERE seq % 37 = 0) n""",
    "task_events": """
        SELECT event_id AS id, concat('p', @str(user_id % 8)) AS project_id, concat('QUEST-', @str(user_id)) AS task_id,
            CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'created' WHEN 'error' THEN 'released' WHEN 'click' THEN 'claimed' ELSE 'noted' END AS event,
            concat('agent', @str(event_id % 17)) AS agent_id, ts AS created_at
        FROM events""",
    "tool_calls": """
        SELECT event_id AS id, concat('s', @str(user_id), '-', @str(day(ts))) AS session_id, ts,
            CASE event_type WHEN 'purchase' THEN 'quest_fulfill' WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'lore_inscribe' WHEN 'click' THEN CASE event_id % 7 WHEN 0 THEN 'quest_accept' WHEN 1 THEN 'quest_brief' ELSE 'quest_journal' END ELSE 'lore_appraise' END AS tool,
            CASE event_id % 6 WHEN 0 THEN 'fix login-page-redirect' WHEN 1 THEN 'QUEST-12' WHEN 2 THEN 'we need to tidy this up' WHEN 3 THEN 'login-redirect' WHEN 4 THEN 'see ENTRY-4 which shows a long enough sentence here' ELSE 'plain words' END AS arg,
            event_id % 5 = 0 AS empty_result, event_id % 9 = 0 AS brief_stale
        FROM events""",
    "vectors": """
        SELECT vec_id + 1 AS id, CASE WHEN vec_id % 19 = 0 THEN 'other' ELSE 'model' END AS model_id, embedding,
            CASE WHEN vec_id % 10 = 0 THEN 'stale' ELSE 'fresh' END AS content
        FROM embeddings""",
    "usage_log": """
        SELECT event_id AS id, ts, concat('p', @str(user_id % 8)) AS project_id, event_type AS tool, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
            cast(floor(value * 100) AS bigint) AS resp_bytes
        FROM events""",
    "hints": """
        SELECT 'h_error' AS rule_id, 'hint' AS severity, true AS enabled UNION ALL SELECT 'h_click', 'fyi', true UNION ALL SELECT 'h_view', 'hint', true
        UNION ALL SELECT 'h_signup', 'warning', true UNION ALL SELECT 'h_none', 'fyi', false""",
    "hint_fires": """
        SELECT event_id AS id, concat('h_', event_type) AS rule_id, concat('s', @str(user_id)) AS session_id, ts AS fired_at,
            CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'click' AND event_id % 31 = 1 THEN 1 WHEN event_type <> 'click' AND event_id % 3 = 0 THEN 1 ELSE 0 END AS followed_through
        FROM events""",
    "file_events": """
        SELECT event_id AS id, concat('src', @str(user_id % 20)) AS project_id, concat('docs/part_', @str(user_id % 50), '.md') AS path, ts,
            CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'write' END AS op
        FROM events""",
    "leases": """
        SELECT project_id, task_id, holder, session_id, heartbeat_at, heartbeat_at + INTERVAL '10' MINUTE AS expires_at FROM (
            SELECT concat('p', @str(e.user_id % 8)) AS project_id, concat('QUEST-', @str(e.user_id)) AS task_id, concat('AGENT', @str(o.o_custkey % 17 + CASE WHEN e.user_id % 5 = 0 THEN 1 ELSE 0 END)) AS holder,
                concat('s', @str(e.user_id)) AS session_id, e.ts AS heartbeat_at, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
            FROM events e JOIN orders o ON o.o_orderkey = e.user_id) x
        WHERE rn = 1""",
    "decision_log": """
        SELECT event_id AS id, ts, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS kind, event_id % 3 <> 0 AS allow,
            concat('path /home/user', @str(user_id), '/x key sk-', 'abcdefghijklmnop', @str(event_id)) AS reason
        FROM events""",
}
_NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", text)] for name, text in VIEWS.items()}


def _spark(sql: str) -> str:
    sql = re.sub(r"@ts'([^']*)'", r"timestamp_ntz'\1'", sql)
    sql = sql.replace("@str(", "string(")
    return re.sub(r"@day\(([^()]*)\)", r"cast(cast(\1 AS date) AS timestamp_ntz)", sql)


def _duck(sql: str) -> str:
    sql = re.sub(r"@ts'([^']*)'", r"TIMESTAMP '\1'", sql)
    sql = re.sub(r"@str\(((?:[^()]|\([^()]*\))*)\)", r"CAST(\1 AS VARCHAR)", sql)
    return re.sub(r"@day\(([^()]*)\)", r"CAST(CAST(\1 AS DATE) AS TIMESTAMP)", sql)


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in [*_ordered(_NEEDS[name]), name]:
            if n not in out:
                out.append(n)
    return out


def oracle(sql: str) -> str:
    """``sql`` with the views it names in front, for the oracle's engine."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    with_ = ",\n".join(f"{v} AS ({_duck(VIEWS[v])})" for v in _ordered(named))
    sql = _duck(sql.strip())
    if not with_:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {with_},\n{sql[14:]}"
    return f"WITH {with_},\n{sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {with_}\n{sql}"


class Views:
    """The tables and views of one folder as DataFrames, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.table(name)
        if name not in self._made:
            text = VIEWS[name]
            base = [t for t in ("documents", "orders", "lineitem", "events", "embeddings") if re.search(rf"\b{t}\b", text)]
            frames = {n: getattr(self, n) for n in [*base, *_NEEDS[name]]}
            for n in frames:
                text = re.sub(rf"(?<=FROM |JOIN ){n}\b", "{" + n + "}", text)
            self._made[name] = self.spark.sql(_spark(text), **frames)
        return self._made[name]

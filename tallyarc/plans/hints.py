"""Queries of the rule engine."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import hints as H
from tallyarc.views import Views

_W = """WITH c AS (SELECT *, coalesce(bool_or(tool = 'session_start') OVER o, false) AS started, coalesce(bool_or(tool = 'quest_brief') OVER o, false) AS briefed, row_number() OVER o AS n,
    coalesce(bool_or(tool = 'lore_appraise') OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS searched,
    coalesce(bool_or(tool = 'quest_accept') OVER (PARTITION BY session_id, upper(trim(arg)) ORDER BY ts, id), false) AS accepted FROM tool_calls WINDOW o AS (PARTITION BY session_id ORDER BY ts, id))"""
_ON = {
    "clear-without-report-detail": "tool = 'quest_fulfill' AND len(string_split(trim(arg), ' ')) < 20",
    "inscribe-looks-like-quest": rf"tool = 'lore_inscribe' AND regexp_matches(lower(arg), '{H.TODO}')",
    "inscribe-without-appraise": "tool = 'lore_inscribe' AND NOT searched",
    "inscribe-without-transfer-reasoning": rf"tool = 'lore_inscribe' AND regexp_matches(arg, '{H.CITES}') AND length(trim(arg)) >= 40 AND NOT regexp_matches(lower(arg), '{H.TRANSFER}')",
    "journal-outside-accepted": "tool = 'quest_journal' AND trim(arg) <> '' AND NOT accepted",
    "no-brief-24h": "tool = 'quest_fulfill' AND brief_stale",
    "no-session-start": "NOT started",
    "session-end-without-brief": "n >= 30 AND NOT briefed",
    "slug-query": rf"tool = 'lore_appraise' AND empty_result AND regexp_matches(trim(arg), '{H.SLUG}')",
}


@query("hint_triggers", _W + " UNION ALL ".join(f" SELECT id, session_id, tool, '{rule}' AS rule_id FROM c WHERE {cond}" for rule, cond in _ON.items()) + " -- tool_calls")
def hint_triggers(v: Views):
    return H.triggers(v.tool_calls)


@query("recently_called", f"{_W} SELECT id, session_id, searched AS recent FROM c")
def recently_called(v: Views):
    return H.recently_called(v.tool_calls, "lore_appraise")


@query("call_count", "SELECT id, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS INTEGER) AS n FROM tool_calls")
def call_count(v: Views):
    return H.call_count(v.tool_calls)


@query("hint_evaluate")
def hint_evaluate(v: Views):
    """Cooldowns and caps depend on the engine's own fires, so sessions are walked in order."""
    return H.evaluate(v.tool_calls).select("id", "session_id", "rule_id")


@query("hint_followup")
def hint_followup(v: Views):
    return H.evaluate(v.tool_calls).where("followed_through IS NOT NULL").select("id", "rule_id", "followed_through", "followup_offset")


@query("cooldown")
def cooldown(v: Views):
    """Fires by rule, after cooldowns."""
    return H.evaluate(v.tool_calls).groupBy("rule_id").agg(F.count("*").alias("fires"))


@query("slug_hint", rf"SELECT id, arg AS query FROM tool_calls WHERE regexp_matches(arg, '{H.SLUG}') AND empty_result")
def slug_hint(v: Views):
    return v.tool_calls.where(F.col("arg").rlike(H.SLUG) & F.col("empty_result")).select("id", F.col("arg").alias("query"))


@query("tool_alias", "SELECT CASE WHEN tool = 'quest_clear' THEN 'quest_fulfill' ELSE tool END AS tool, count(*) AS n FROM (SELECT CASE WHEN id % 2 = 0 AND tool = 'quest_fulfill' THEN 'quest_clear' ELSE tool END AS tool FROM tool_calls) x GROUP BY ALL")
def tool_alias(v: Views):
    tool = F.when((F.col("id") % 2 == 0) & (F.col("tool") == "quest_fulfill"), "quest_clear").otherwise(F.col("tool"))
    return v.tool_calls.groupBy(H.canonical(tool).alias("tool")).agg(F.count("*").alias("n"))


@query("severity_rank", "SELECT f.id, f.rule_id, CASE severity WHEN 'blocker' THEN 4 WHEN 'warning' THEN 3 WHEN 'fyi' THEN 1 ELSE 2 END AS rank FROM hint_fires f LEFT JOIN hints h USING (rule_id)")
def severity_rank(v: Views):
    """Of every fire."""
    return v.hint_fires.join(v.hints, "rule_id", "left").select("id", "rule_id", H.severity_rank(F.col("severity")).alias("rank"))

"""Queries of scalar rules."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.functions.text import DEDUP_STOP, STOP_WORDS, dedup_query_text, query_text
from tallyarc.operators.board import split_list, split_pair
from tallyarc.views import Views

_STOP, _LONG = (", ".join(f"'{w}'" for w in x) for x in (STOP_WORDS, DEDUP_STOP))


def _any(text: str) -> str:
    every = f"regexp_extract_all(lower({text}), '[a-z0-9_]+')"
    kept = f"list_filter({every}, lambda w: w NOT IN ({_STOP}))"
    return f"coalesce(array_to_string(list_transform(list_filter(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {every} END, lambda w: length(w) >= 2), lambda w: concat(w, '*')), ' OR '), '')"


@query("fts_query_or", f"SELECT id, {_any('title')} AS query FROM entries")
def fts_query_or(v: Views):
    return v.entries.select("id", query_text(F.col("title")).alias("query"))


@query("fts_query_quest", f"SELECT task_id, id, {_any('note')} AS query FROM task_notes")
def fts_query_quest(v: Views):
    return v.task_notes.select("task_id", "id", query_text(F.col("note")).alias("query"))


@query("fts_query_dedup_and", f"""SELECT id, CASE WHEN len(w) >= 3 THEN array_to_string(list_transform(w[1:5], lambda x: concat(x, '*')), ' AND ') ELSE '' END AS query
    FROM (SELECT id, list_filter(regexp_extract_all(lower(title), '[a-z0-9_]+'), lambda x: length(x) >= 4 AND x NOT IN ({_LONG})) AS w FROM entries) t""")
def fts_query_dedup_and(v: Views):
    return v.entries.select("id", dedup_query_text(F.col("title")).alias("query"))


@query("parse_entry_id", r"SELECT id, TRY_CAST(regexp_extract(t, '(?i)^\s*(?:LORE-|ENTRY-)?([0-9]+)\s*$', 1) AS BIGINT) AS parsed FROM (SELECT id, CASE id % 4 WHEN 0 THEN concat('LORE-', @str(id)) WHEN 1 THEN concat(' entry-', @str(id)) WHEN 2 THEN @str(id) ELSE concat('x', @str(id)) END AS t FROM entries) x")
def parse_entry_id(v: Views):
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("LORE-"), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, F.concat(F.lit(" entry-"), F.col("id").cast("string"))).when(F.col("id") % 4 == 2, F.col("id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("id").cast("string")))
    return v.entries.select("id", F.regexp_extract(text, r"(?i)^\s*(?:LORE-|ENTRY-)?([0-9]+)\s*$", 1).alias("t")).select("id", F.expr("try_cast(t AS bigint)").alias("parsed"))


@query("flex_int", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def flex_int(v: Views):
    return v.events.select("event_id", F.get_json_object("props", "$.k").alias("k")).select("event_id", F.expr("try_cast(k AS bigint)").alias("k"))


@query("split_kv", r"SELECT id, lower(trim(string_split(t, ':')[1])) AS key, trim(substr(t, instr(t, ':') + 1)) AS value FROM (SELECT id, concat('Key', @str(id % 3), CASE WHEN id % 2 = 0 THEN ': ' ELSE ':' END, 'v', @str(id)) AS t FROM entries) x")
def split_kv(v: Views):
    text = F.concat(F.lit("Key"), (F.col("id") % 3).cast("string"), F.when(F.col("id") % 2 == 0, ": ").otherwise(":"), F.lit("v"), F.col("id").cast("string"))
    key, value = split_pair(F.col("t"))
    return v.entries.select("id", text.alias("t")).select("id", key.alias("key"), value.alias("value"))


@query("split_list", "SELECT id, concat('a', @str(id), '|', 'b') AS items FROM entries")
def split_list_(v: Views):
    text = F.concat(F.lit("[ a"), F.col("id").cast("string"), F.lit(", , b ]"))
    return v.entries.select("id", F.array_join(split_list(text), "|").alias("items"))


@query("append_unique", "SELECT id, tags AS items FROM entries WHERE id % 7 <> 0 AND string_split(tags, ',')[1] <> string_split(tags, ',')[2]")
def append_unique(v: Views):
    parts = F.split("tags", ",")
    own = v.entries.where("id % 7 <> 0").where(parts[0] != parts[1])
    return own.select("id", F.array_join(F.array_distinct(F.concat(parts, F.split("tags", ","))), ",").alias("items"))


@query("short_session_id", "SELECT id, substr(session_id, 1, 8) AS short FROM tool_calls")
def short_session_id(v: Views):
    return v.tool_calls.select("id", F.substring("session_id", 1, 8).alias("short"))


@query("timestamp_layouts", "SELECT id, created_at AS parsed FROM entries")
def timestamp_layouts(v: Views):
    """Times written in several layouts, read back by the first that fits."""
    ts = F.col("created_at").cast("timestamp")
    text = F.when(F.col("id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    layouts = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss"]
    return v.entries.select("id", text.alias("t")).select("id", F.coalesce(*(F.try_to_timestamp("t", F.lit(x)) for x in layouts)).cast("timestamp_ntz").alias("parsed"))


@query("bucket_keys", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS hour, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events")
def bucket_keys(v: Views):
    return v.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("minute"))


@query("era_severity", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fyi' WHEN 1 THEN 'hint' ELSE 'warning' END AS severity FROM events")
def era_severity(v: Views):
    """A JSON map of severities by era, looked up; the rule's own where the map has none."""
    maps = F.when(F.col("event_id") % 3 == 0, F.lit('{"late": "fyi"}')).when(F.col("event_id") % 3 == 1, F.lit('{"early": "blocker"}')).otherwise(F.lit('{"late": "warning"}'))
    return v.events.select("event_id", F.coalesce(F.from_json(maps, "map<string,string>")["late"], F.lit("hint")).alias("severity"))


@query("since_filter", "SELECT id FROM entries WHERE created_at >= @ts'2026-06-15 00:00:00' - INTERVAL '90' DAY")
def since_filter(v: Views):
    from tallyarc.functions.durations import days
    from tallyarc.views import NOW

    return v.entries.where(F.col("created_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days('3m')}' DAY")).select("id")


@query("hamming_popcount", "SELECT event_id, bit_count(xor(event_id, user_id)) AS distance FROM events")
def hamming_popcount(v: Views):
    return v.events.select("event_id", F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).alias("distance"))


@query("identity_changed", "SELECT id, (model_id <> '' AND model_id <> 'model') AS changed FROM vectors")
def identity_changed(v: Views):
    return v.vectors.select("id", ((F.col("model_id") != "") & (F.col("model_id") != "model")).alias("changed"))


@query("wordpiece_tokenize")
def wordpiece_tokenize(v: Views):
    """Greedy longest-match pieces of whole texts by a given vocabulary: here frequent word starts and ends."""
    from tallyarc.functions.wordpiece import pieces_udf

    vocab = ["the", "th", "an", "re", "er", "in", "on", "t", "a", "e", "##e", "##n", "##the", "##er", "##ing", "##tion", "##an", "##t", "##s", "##h", "##d", "##r", "##a", "##o", "##i"]
    return v.entries.select("id", F.array_join(pieces_udf(vocab)("summary"), " ").alias("pieces"))

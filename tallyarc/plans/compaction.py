"""Queries of text compaction."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tallyarc.catalogue import query
from tallyarc.functions import compact as C
from tallyarc.functions import loglines as L
from tallyarc.views import Views


def _map(f, kind=None):
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return F.pandas_udf(run, kind or StringType())


#: What stands before the lines of documents, by (id + place) modulo seven, so that every rule meets lines it is made for.
_BEFORE = ["ERROR code=17: ", "warning: took 42 ms ", "info: user=3 ", "  at f (x.js:1) ", "test 9 failed: ", "", "12 passed "]
_CASE = "CASE (id + {at}) % 7 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_BEFORE[:-1])) + f" ELSE '{_BEFORE[-1]}' END"


def _log_lines(v: Views):
    """The lines of whole documents with log words in front: ``id, pos, line``."""
    own = v.entries.select("id", F.posexplode(F.split("summary", "\n")).alias("pos", "text"))
    return own.select("id", "pos", F.concat(F.expr(_CASE.format(at="pos")), "text").alias("line"))


def _log_texts(v: Views):
    """Each document's lines as one log."""
    line = "transform(split(summary, '\\n'), (x, pos) -> concat(" + _CASE.format(at="pos") + ", x))"
    return v.entries.select("id", F.expr(f"array_join({line}, '\\n')").alias("text"))


_LINES = f"SELECT id, pos, concat({_CASE.format(at='pos')}, t) AS line FROM (SELECT id, CAST(generate_subscripts(string_split(summary, chr(10)), 1) - 1 AS INTEGER) AS pos, unnest(string_split(summary, chr(10))) AS t FROM entries) x"
_LEVEL = "CASE regexp_extract(lower(line), '\\b(error|fatal|critical|failed|fail|warning|warn|info|debug|trace)\\b', 1) WHEN '' THEN 'unknown' WHEN 'error' THEN 'error' WHEN 'fatal' THEN 'error' WHEN 'critical' THEN 'error' WHEN 'failed' THEN 'fail' WHEN 'fail' THEN 'fail' WHEN 'warning' THEN 'warn' WHEN 'warn' THEN 'warn' WHEN 'info' THEN 'info' WHEN 'debug' THEN 'debug' ELSE 'trace' END"
_TRACED = f"regexp_matches(line, '{C.TRACE}')"
_SUMMED = f"(regexp_matches(line, '{C.SUMMARY_RULE}') OR regexp_matches(lower(line), '{C.SUMMARY_COUNTS}') OR regexp_matches(lower(line), '^({'|'.join(C.SUMMARY_STARTS)})'))"


@query("log_level", f"SELECT id, pos, {_LEVEL} AS level FROM ({_LINES}) l")
def log_level(v: Views):
    return _log_lines(v).select("id", "pos", L.level(F.col("line")).alias("level"))


@query("log_trace", f"SELECT id, pos, {_TRACED} AS trace FROM ({_LINES}) l")
def log_trace(v: Views):
    return _log_lines(v).select("id", "pos", L.is_trace(F.col("line")).alias("trace"))


@query("log_summary_line", f"SELECT id, pos, {_SUMMED} AS summary FROM ({_LINES}) l")
def log_summary_line(v: Views):
    return _log_lines(v).select("id", "pos", L.is_summary(F.col("line")).alias("summary"))


@query("log_score", f"SELECT id, pos, round(least(1e0, CASE {_LEVEL} WHEN 'error' THEN 1e0 WHEN 'fail' THEN 1e0 WHEN 'warn' THEN 6e-1 WHEN 'info' THEN 3e-1 ELSE 1e-1 END + CASE WHEN {_TRACED} THEN 3e-1 ELSE 0e0 END + CASE WHEN {_SUMMED} THEN 4e-1 ELSE 0e0 END), 6) AS score FROM ({_LINES}) l")
def log_score(v: Views):
    return _log_lines(v).select("id", "pos", F.round(L.score(F.col("line")), 6).alias("score"))


@query("log_dedupe_key", rf"""SELECT id, pos, CASE WHEN cut > 0 THEN concat(substr(line, 1, cut - 1), regexp_replace(substr(line, cut), '[0-9]+', '#', 'g')) ELSE line END AS key
    FROM (SELECT *, CASE WHEN instr(line, ':') = 0 THEN instr(line, '=') WHEN instr(line, '=') = 0 THEN instr(line, ':') ELSE least(instr(line, ':'), instr(line, '=')) END AS cut FROM ({_LINES}) l) k""")
def log_dedupe_key(v: Views):
    return _log_lines(v).select("id", "pos", L.dedupe_key(F.col("line")).alias("key"))


@query("stack_runs", f"SELECT id, CAST(min(pos) AS INTEGER) AS first, count(*) AS n FROM (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM ({_LINES}) l WHERE {_LEVEL} IN ('error', 'fail') OR {_TRACED}) x GROUP BY id, island")
def stack_runs(v: Views):
    """Runs of adjacent lines of errors, failures and traces: gaps and islands."""
    from pyspark.sql import Window as W

    own = _log_lines(v).where(L.level(F.col("line")).isin("error", "fail") | L.is_trace(F.col("line")))
    own = own.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("id").orderBy("pos")))
    return own.groupBy("id", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n")).drop("island")


@query("detect_strategy")
def detect_strategy(v: Views):
    return v.entries.select("id", _map(C.detect)("summary").alias("strategy"))


@query("ccr_put", "SELECT id, substr(sha256(summary), 1, 24) AS key FROM entries")
def ccr_put(v: Views):
    return v.entries.select("id", F.substring(F.sha2("summary", 256), 1, 24).alias("key"))


@query("ccr_get", "SELECT e.id, s.body AS found FROM entries e JOIN (SELECT substr(sha256(summary), 1, 24) AS key, min(summary) AS body FROM entries WHERE created_at >= @ts'2026-01-01 00:00:00' GROUP BY 1) s ON s.key = substr(sha256(e.summary), 1, 24)")
def ccr_get(v: Views):
    """Texts by the key of their marker, those that are too old gone."""
    keyed = v.entries.withColumn("key", F.substring(F.sha2("summary", 256), 1, 24))
    store = keyed.where(F.col("created_at") >= F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).groupBy("key").agg(F.min("summary").alias("found"))
    return keyed.select("id", "key").join(store, "key").select("id", "found")


_ROW = "id:bigint,kind:string,access_count:bigint,valid_days:int,note:string"


def _rows_json(v: Views):
    """Arrays of objects made of entries, those of 400 ids a project at most in each."""
    row = F.struct("id", "kind", "access_count", F.when(F.col("id") % 2 == 0, F.col("valid_days")).alias("valid_days"), F.when(F.col("id") % 3 == 0, F.col("title")).alias("note"))
    own = v.entries.groupBy("project_id", F.floor((F.col("id") - 1) / 400).alias("block"))
    return own.agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("json", F.to_json("rows")).drop("rows")


@query("json_crush")
def json_crush(v: Views):
    """Arrays as tables; one of a single object stays as it is."""
    return _rows_json(v).select("project_id", "block", _map(lambda x: C.crush(x) or x)("json").alias("table"))


@query("json_restore", "SELECT project_id, id, kind, access_count, CASE WHEN id % 2 = 0 THEN valid_days END AS valid_days, CASE WHEN id % 3 = 0 THEN title END AS note FROM entries")
def json_restore(v: Views):
    """What is crushed comes back as the rows that it was made of."""
    back = json_crush(v).select("project_id", F.from_json(_map(lambda x: C.restore(x) or x)("table"), f"array<struct<{_ROW}>>").alias("rows"))
    return back.select("project_id", F.inline("rows"))


@query("log_compress")
def log_compress(v: Views):
    return _log_texts(v).select("id", _map(C.compress_log)("text").alias("text"))


@query("search_compress")
def search_compress(v: Views):
    """Each document's lines as matches in three files."""
    text = F.expr("array_join(transform(split(summary, '\\n'), (x, pos) -> concat('src/f', pos % 3, '.py:', pos + 1, ':', x)), '\\n')")
    return v.entries.select("id", text.alias("text")).select("id", _map(lambda x: C.compress_matches(x, "error tion"))("text").alias("text"))


@query("diff_compress")
def diff_compress(v: Views):
    """Each document's lines as hunks that replace a line."""
    hunk = "concat('@@ -', pos * 9 + 1, ',4 +', pos * 9 + 1, ',4 @@\\n context\\n-', x, '\\n+', kind, '\\n more\\n last')"
    text = F.expr(f"concat('diff --git a/x b/x\\n--- a/x\\n+++ b/x\\n', array_join(transform(split(summary, '\\n'), (x, pos) -> {hunk}), '\\n'))")
    return v.entries.select("id", text.alias("text")).select("id", _map(lambda x: C.compress_diff(x, "principle"))("text").alias("text"))


@query("adaptive_k")
def adaptive_k(v: Views):
    """How many of a document's lines say most of it."""
    return v.entries.select("id", _map(lambda x: C.adaptive_k(x.split("\n")), LongType())("summary").alias("k"))


@query("simhash64")
def simhash64(v: Views):
    return v.entries.select("id", _map(lambda x: f"{C.simhash64(x):016x}")("summary").alias("hash"))


@query("dossier_compact")
def dossier_compact(v: Views):
    from tallyarc.operators import archive as A

    return A.dossier_text(A.dossier(v.entries), v.entries).select("project_id", _map(C.compress_log)("text").alias("text"))

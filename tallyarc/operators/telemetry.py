"""Usage, decisions and metrics: logs parsed, rolled up and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyarc.sources.snapshot import cut_bytes

SECRET = r"\b(?:sk|pk|ghp|gho|xox[baprs])[-_][A-Za-z0-9]{16,}\b"
HOME = r"/(Users|home)/[^/\s]+"
#: The metrics that are exposed, with their kinds.
METRICS = [
    ("decisions_total", "counter"), ("decisions_allowed_total", "counter"), ("decisions_denied_total", "counter"), ("passes_total", "counter"),
    ("renewals_total", "counter"), ("melds_total", "counter"), ("embedded_total", "counter"), ("leases_reaped_total", "counter"),
    ("events_dropped_total", "counter"), ("sessions", "gauge"), ("leases", "gauge"),
]
PRUNE_RATE, PRUNE_SCORED = 0.1446, 20


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET, "[redacted]"), HOME, "~")


def parse_usage(lines: DataFrame) -> DataFrame:
    """Rows of ``lines(value)``: tab-separated time, project, tool, exit, milliseconds and, if there, bytes; others are skipped."""
    part = F.split("value", "\t")
    n = lambda i: F.expr(f"try_cast(get(parts, {i}) AS bigint)")
    rows = lines.select(part.alias("parts")).where(F.size("parts") >= 5)
    out = rows.select(F.expr("try_to_timestamp(get(parts, 0))").alias("ts"), F.get("parts", F.lit(1)).alias("project_id"), F.get("parts", F.lit(2)).alias("tool"), n(3).alias("exit_code"), n(4).alias("duration_ms"), F.coalesce(n(5), F.lit(0)).alias("resp_bytes"))
    return out.where("ts IS NOT NULL")


def usage_lines(usage: DataFrame) -> DataFrame:
    """The same rows as text, names cut to their bounds in bytes."""
    cut = lambda c, n: cut_bytes(F.col(c), n)
    return usage.select(F.concat_ws("\t", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), cut("project_id", 64), cut("tool", 64), F.col("exit_code").cast("string"), F.lit("0"), F.col("resp_bytes").cast("string")).alias("value"))


def miss_lines(misses: DataFrame) -> DataFrame:
    """Searches without a hit, ``(ts, project_id, query)``, as JSON lines; the project is cut to 64 bytes, the query to 256."""
    row = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), cut_bytes(F.col("project_id"), 64).alias("project_id"), cut_bytes(F.col("query"), 256).alias("query"))
    return misses.select(F.to_json(row).alias("value"))


def parse_misses(lines: DataFrame) -> DataFrame:
    """Rows of ``lines(value)``; broken ones are skipped."""
    parsed = lines.select(F.from_json("value", "ts timestamp, project_id string, query string").alias("r"))
    return parsed.where("r.ts IS NOT NULL").select(F.col("r.ts").cast("timestamp_ntz").alias("ts"), "r.project_id", "r.query")


def tokens(size: Column) -> Column:
    return F.floor((size + 3) / 4)


def by_tool(usage: DataFrame) -> DataFrame:
    out = usage.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("resp_bytes").alias("bytes"))
    return out.withColumn("tokens", tokens(F.col("bytes"))).withColumn("mean_tokens", F.floor(F.col("tokens") / F.col("calls")))


def by_session(usage: DataFrame) -> DataFrame:
    """Per project and minute."""
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    out = usage.groupBy("project_id", minute.alias("minute")).agg(F.min("ts").alias("start"), F.count("*").alias("calls"), F.sum("resp_bytes").alias("bytes"))
    return out.withColumn("tokens", tokens(F.col("bytes")))


def latest_session(usage: DataFrame) -> DataFrame:
    last = usage.agg(F.max_by(F.struct("project_id", "ts"), F.struct("ts", -F.col("id"))).alias("r"))
    return last.select(F.concat("r.project_id", F.lit("@"), F.date_format("r.ts", "yyyy-MM-dd'T'HH:mm")).alias("session"))


def rollup(events: DataFrame, unit: str) -> DataFrame:
    kind = F.when(F.trim(F.coalesce("kind", F.lit(""))) == "", "unknown").otherwise(F.col("kind"))
    return events.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"), kind.alias("kind")).agg(F.count("*").alias("n"))


def replay(events: DataFrame, watermark: Column, unit: str = "hour") -> DataFrame:
    """Only what is strictly after the watermark counts."""
    return rollup(events.where(F.col("ts") > watermark), unit)


def hint_stats(hints: DataFrame, fires: DataFrame) -> DataFrame:
    scored = F.count("followed_through")
    hits = F.count_if(F.col("followed_through") == 1)
    out = hints.join(fires.select("rule_id", "followed_through", F.col("id").alias("fire")), "rule_id", "left").groupBy("rule_id", "severity", "enabled").agg(F.count("fire").alias("fires"), scored.alias("scored"), hits.alias("hits"))
    return out.withColumn("rate", F.when(F.col("scored") == 0, 0.0).otherwise(F.round(F.col("hits") / F.greatest("scored", F.lit(1)), 6)))


def hint_prune(stats: DataFrame) -> DataFrame:
    low = F.col("enabled") & F.col("severity").isin("hint", "fyi") & (F.col("scored") >= PRUNE_SCORED) & (F.col("rate") < PRUNE_RATE)
    return stats.where(low).select("rule_id", F.when(F.col("severity") == "hint", "demote to fyi").otherwise("disable").alias("action"))


def exposition(values: DataFrame) -> DataFrame:
    """``values(name, kind, value)`` as text, by name."""
    block = F.concat(F.lit("# HELP "), "name", F.lit(" "), F.regexp_replace("name", "_", " "), F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"), "name", F.lit(" "), F.col("value").cast("string"), F.lit("\n"))
    return values.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", block.alias("text")))), lambda x: x["text"]), "").alias("text"))  # a row for each metric


def narrate(ops: DataFrame) -> DataFrame:
    """Per journal: merges, renewals, embedded (a row counts one unless its detail has a count), approvals, partial steps."""
    count = F.coalesce(F.expr("try_cast(get_json_object(detail, '$.count') AS bigint)"), F.lit(1))
    return ops.groupBy("pass_id").agg(
        F.count_if((F.col("kind") == "meld") & F.col("applied")).alias("melds"),
        F.count_if((F.col("kind") == "renewal") & F.col("applied")).alias("renewals"),
        F.coalesce(F.sum(F.when((F.col("kind") == "embed") & F.col("applied"), count)), F.lit(0)).alias("embedded"),
        F.count_if((F.col("policy") == "approval") & ~F.col("applied")).alias("awaiting"),
        F.count_if(F.col("kind") == "partial").alias("partial"),
    )


def first_after(fires: DataFrame, events: DataFrame, within: int = 10) -> DataFrame:
    """Each fire with the first later event of its session, of the next ``within``, that satisfies its rule (column ``ok``)."""
    order = W.partitionBy("session_id").orderBy("ts", "id")
    seen = events.withColumn("pos", F.row_number().over(order)).withColumn("hit_at", F.min(F.when(F.col("ok"), F.col("pos"))).over(W.partitionBy("session_id").orderBy("pos").rowsBetween(1, within)))
    return fires.join(seen.select("session_id", "id", "pos", "hit_at"), ["session_id", "id"]).select("session_id", "id", (F.col("hit_at") - F.col("pos")).alias("offset"))

"""Writing to the board's logs, budgets of maintenance, gates, and small renderers."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyarc.functions.numbering import running

KEY = ["project_id", "task_id"]


def append_note(notes: DataFrame, new: DataFrame) -> DataFrame:
    """``notes`` with ``new(project_id, task_id, agent_id, note, created_at)`` under ids after the greatest."""
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = running(new, [F.col(c) for c in ("created_at", *KEY, "note")], "rn").crossJoin(F.broadcast(top))  # one row
    return notes.unionByName(rows.select((F.col("top") + F.col("rn")).alias("id"), *(c for c in notes.columns if c != "id")))


def update_notes(changes: DataFrame) -> DataFrame:
    """Notes of ``changes(project_id, task_id, field, items, mode)``: append, replace or clear a list; a scalar is one item."""
    joined = F.array_join("items", ", ")
    note = F.when(F.col("mode") == "append", F.concat(F.lit("[spec] "), "field", F.lit(": "), joined)).otherwise(F.concat(F.lit("[spec-replace] "), "field", F.lit(": "), F.when(F.col("mode") == "replace", joined).otherwise("")))
    clash = changes.groupBy(*KEY, "field").agg(F.count_distinct("mode").alias("n")).where("n > 1")
    return changes.join(clash, [*KEY, "field"], "left_anti").select(*KEY, note.alias("note"))


def checkpoint_note(done: Column, now: Column, next_: Column) -> Column:
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in (("done", done), ("now", now), ("next", next_))]
    return F.concat(F.lit("[checkpoint] "), F.concat_ws(" | ", *parts))


def set_epic(status: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of ``wanted(project_id, task_id, epic)`` are applied: those of tasks that are there."""
    there = status.select(*KEY, F.lit(True).alias("there")).distinct()
    return wanted.join(there, KEY, "left").select(*KEY, "epic", F.when(F.col("there"), "applied").otherwise("skipped").alias("outcome"))


def summon(status: DataFrame, orders: DataFrame) -> DataFrame:
    """Tasks of ``orders(project_id, task_id, agent)`` are given to the agent, whoever has them."""
    new = orders.groupBy(*KEY).agg(F.min("agent").alias("_agent"))
    joined = status.join(new, KEY, "left")
    given = F.col("_agent").isNotNull() & (F.col("status") != "done")
    return joined.select(*KEY, F.when(given, "in_progress").otherwise(F.col("status")).alias("status"), F.when(given, F.col("_agent")).otherwise(F.col("claimed_by")).alias("claimed_by"))


def register_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Projects ``(id, path, tasks_file)``; a new row of an id replaces it."""
    fresh = new.select("id", "path", F.coalesce("tasks_file", F.lit("TASKS.md")).alias("tasks_file"))
    return fresh.unionByName(projects.join(fresh.select("id"), "id", "left_anti"))


def resolve_projects(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """The project of each of ``requests(id, flag, top_level, main_repo)``: by name where one is given, else by the path of the working
    tree, else by that of its main repository; ``error`` says when none of them is registered."""
    name = lambda key, to: projects.select(F.col(key).alias(to), F.col("id").alias(f"by_{to}")).dropDuplicates([to])
    joined = requests.join(name("id", "flag"), "flag", "left").join(name("path", "top_level"), "top_level", "left").join(name("path", "main_repo"), "main_repo", "left")
    named = F.coalesce("flag", F.lit("")) != ""
    found = F.when(named, F.col("by_flag")).otherwise(F.coalesce("by_top_level", "by_main_repo"))
    return joined.select("id", found.alias("project_id"), F.when(found.isNull(), "the project is not registered").alias("error"))


def resolve_session(argument: Column, saved: Column, env: Column) -> Column:
    """The first that is named: the argument, the saved project, the environment's; null where none is."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (argument, saved, env)))


def warm_start(state: Column, stored_model: Column, bound_model: Column, stored_hash: Column, bound_hash: Column) -> Column:
    """Whether the embedder's self-test can be left out, and if not, why."""
    changed = lambda stored, bound: (F.coalesce(stored, F.lit("")) != "") & (stored != bound)
    return F.when(state != "enabled", "not-enabled").when(changed(stored_model, bound_model) | changed(stored_hash, bound_hash), "identity-changed").otherwise("skip-probe")


def agent_environment(env: dict[str, str], markers: tuple[str, ...] = ("CI_AGENT", "AGENT")) -> bool:
    return any(env.get(m) for m in markers)


def run_steps(steps: list[tuple[str, Callable[[], dict]]], budget_seconds: float, clock: Callable[[], float] = time.monotonic) -> list[tuple[str, str, dict]]:
    """Steps in order until the budget is spent: what each did, ``skipped`` for the rest; one that fails does not stop the others."""
    began, out = clock(), []
    for name, step in steps:
        if clock() - began >= budget_seconds:
            out.append((name, "skipped", {}))
            continue
        try:
            out.append((name, "done", step()))
        except Exception as e:  # a step's failure is its own
            out.append((name, "error", {"error": str(e)}))
    return out


def plan_steps(steps: DataFrame, budget_seconds: float) -> DataFrame:
    """What a run's steps ``(run, place, step, seconds, fails)`` come to under a budget: steps begin in order while less than the budget
    is spent, the rest is skipped; one that fails spends its time and does not stop the others. (``run_steps`` runs real ones.)"""
    before = F.coalesce(F.sum("seconds").over(W.partitionBy("run").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("outcome", F.when(before >= budget_seconds, "skipped").when(F.col("fails"), "error").otherwise("done"))


def backfill_cycles(corpora: DataFrame, least: float = 0.90, cycles: int = 5) -> DataFrame:
    """How many each cycle embeds of ``corpora(corpus, eligible, pending, per_cycle)``: until enough is covered, a cycle does nothing, or
    there were ``cycles``."""
    left = F.col("pending") - (F.col("cycle") - 1) * F.col("per_cycle")
    each = corpora.where("per_cycle > 0").withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(cycles)))).withColumn("left", left)
    run = (F.col("left") > 0) & ((F.col("eligible") - F.col("left")) / F.greatest("eligible", F.lit(1)) < least)
    return each.where(run).select("corpus", "cycle", F.least("per_cycle", "left").alias("done"))


def file_starts(lines: DataFrame, limit: int) -> DataFrame:
    """``(n, is_start)`` of ``lines(n, bytes)`` numbered from 1 in order: where log files begin. A file ends with the line that brings it
    to ``limit``, and the next begins from nothing, so where files begin depends on all before.

    For every line the one after the end of a file that began with it is known from running sums alone: a line's sum and the sum to
    be reached fall into stretches of ``limit`` bytes, and the line wanted is in the same stretch or is the first of the next
    (lines longer than the limit count as the limit, which changes no end). From the first line these steps are then
    followed with doubled strides, so the rounds grow with the logarithm of the number of files."""
    from tallyarc.session import scratch_path

    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, "rotation")
    size = F.least(F.col("bytes"), F.lit(limit))
    running(lines.select("n", size.alias("bytes")), [F.col("n")], "sum", F.col("bytes")).select("n", "bytes", "sum").write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    here = sums.select(F.expr(f"sum div {limit}").alias("stretch"), F.col("sum").alias("value"), F.lit(1).alias("line"), "n")
    goal = F.col("sum") - F.col("bytes") + limit
    wish = sums.select(F.expr(f"(sum - bytes) div {limit} + 1").alias("stretch"), goal.alias("value"), F.lit(0).alias("line"), "n")
    after = W.partitionBy("stretch").orderBy("value", "line", "n").rowsBetween(W.currentRow, W.unboundedFollowing)  # lines of one stretch
    met = here.union(wish).withColumn("end", F.min(F.when(F.col("line") == 1, F.col("n"))).over(after)).where("line = 0")
    first = here.groupBy((F.col("stretch") - 1).alias("stretch")).agg(F.min("n").alias("first"))
    step = met.join(first, "stretch", "left").select("n", (F.coalesce("end", "first") + 1).alias("to"))
    total = sums.count()
    step.where(F.col("to") <= total).write.parquet(f"{path}/steps-0")
    reached, turn = spark.range(1, 2).select(F.col("id").alias("n")), 0
    while True:
        steps = spark.read.parquet(f"{path}/steps-{turn}")
        reached.union(reached.join(steps, "n").select(F.col("to").alias("n"))).write.parquet(f"{path}/reached-{turn}")
        before, reached = reached, spark.read.parquet(f"{path}/reached-{turn}")
        if reached.count() == before.count():
            break
        far = steps.select(F.col("n").alias("to"), F.col("to").alias("next"))
        steps.join(far, "to").select("n", F.col("next").alias("to")).write.parquet(f"{path}/steps-{turn + 1}")
        turn += 1
    return sums.select("n").join(reached.distinct().withColumn("is_start", F.lit(True)), "n", "left").select("n", F.coalesce("is_start", F.lit(False)).alias("is_start"))


def rotate(lines: DataFrame, limit: int = 10 << 20, keep: int = 5) -> DataFrame:
    """``lines(id, bytes)`` with the log file that each is in, from 0, and whether that file is still there: the newest and ``keep``
    archives."""
    numbered = running(lines.select("id", "bytes"), [F.col("id")], "n")
    starts = file_starts(numbered.select("n", "bytes"), limit)
    filed = running(starts, [F.col("n")], "file", F.col("is_start").cast("int")).select("n", (F.col("file") - 1).alias("file"))
    placed = numbered.join(filed, "n").drop("n")
    newest = placed.agg(F.max("file").alias("newest"))
    return placed.crossJoin(F.broadcast(newest)).withColumn("kept", F.col("file") >= F.col("newest") - keep).drop("newest")  # one row


def widened(scored: DataFrame, want: int = 10) -> DataFrame:
    """How far a search ``(id, score, ok)`` that fetches ``want`` rows and doubles that until enough are ok has to go: ``(found, rank, k)``, the
    rows that are ok, the rank of the last one, and the width. Only the last row's place is counted, nothing is ranked whole."""
    last = scored.where("ok").orderBy("score", "id").limit(want).agg(F.count("*").alias("found"), F.max(F.struct("score", "id")).alias("last"))
    within = F.when(F.col("found") < want, True).otherwise(F.struct("score", "id") <= F.col("last"))
    rank = scored.crossJoin(F.broadcast(last)).agg(F.coalesce(F.max("found"), F.lit(0)).alias("found"), F.count_if(within).alias("rank"))  # one row
    return rank.withColumn("k", (want * F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("rank", F.lit(1)) / want) - 1e-9)))).cast("long"))


def seeds(entries: DataFrame, age: Column) -> DataFrame:
    """Entries as rows of an evaluation's corpus: a slug of the title, the kind, the age in days."""
    slug = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    return entries.select("id", F.replace(slug, F.lit(" "), F.lit("-")).alias("slug"), "kind", age.alias("age_days"))


def bounties_text(ranked: DataFrame) -> DataFrame:
    line = F.when(F.col("place") == 0, F.concat(F.lit("TOP "), "task_id")).otherwise(F.concat(F.lit("  + "), "task_id"))
    rows = F.array_sort(F.collect_list(F.struct("place", "task_id", line.alias("line"))))
    return ranked.groupBy("project_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def clamp(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)


def split_statements(script: str | None) -> list[str]:
    """Statements of an SQL script; the semicolons inside a trigger's BEGIN ... END do not end it."""
    out, own, depth = [], [], 0
    for line in (script or "").splitlines():
        bare = line.split("--")[0].strip()
        if not bare:
            continue
        own.append(bare)
        words = bare.upper().split()
        depth += words[-1] == "BEGIN"
        depth -= words[0].rstrip(";") == "END"
        if bare.endswith(";") and depth <= 0:
            out.append(" ".join(own))
            own, depth = [], 0
    return out + [" ".join(own)] * bool(own)


@F.pandas_udf(ArrayType(StringType()))
def statements(scripts: pd.Series) -> pd.Series:
    return scripts.map(split_statements)


#: Operations that may be done without approval.
AUTOMATIC = ("meld_exact", "renewal", "embed")


def policy(kind: Column) -> Column:
    return F.when(kind.isin(*AUTOMATIC), "auto").otherwise("approval")

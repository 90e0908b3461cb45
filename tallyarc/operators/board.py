"""The task board: specs folded from append-only notes, states, dependencies, claims, and reports.

All mutation is facts appended to logs; current state is a view, the latest or the first fact of a key. One writer appends to a
log; concurrent claims are resolved by order (the first wins), not by a lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["project_id", "task_id"]
#: Prefixes of notes that the system writes.
SYSTEM_PREFIXES = ("[spec] ", "[spec-replace] ", "[rework] of: ", "[checkpoint] ", "[completed] ", "[renewal] entry: ")
SCALARS = ("subject", "priority", "epic")
LISTS = ("files", "depends_on", "blocks", "acceptance")


def is_system_note(note: Column) -> Column:
    first, *rest = (note.startswith(p) for p in SYSTEM_PREFIXES)
    for cond in rest:
        first = first | cond
    return first


def priority_rank(priority: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(priority, F.lit(""))))
    return F.when(p == "p0", 0).when(p == "p1", 1).when(p == "p2", 2).when(p == "p3", 3).otherwise(9)


def split_list(text: Column) -> Column:
    """Parts between commas, trimmed, without blanks; one bracket on either side goes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[", ""), r"\]$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_pair(part: Column) -> tuple[Column, Column]:
    """Key and value of ``key: value``; the first colon with a space parts them, else the first colon."""
    spaced = F.instr(part, ": ")
    plain = F.instr(part, ":")
    key = F.when(spaced > 0, F.expr("1")).otherwise(0)
    at = F.when(key == 1, spaced).otherwise(plain)
    return F.lower(F.trim(F.substring(part, F.lit(1), at - 1))), F.trim(F.substring(part, at + F.when(key == 1, 2).otherwise(1), F.length(part)))


def spec_parts(notes: DataFrame) -> DataFrame:
    """A row for each field that a spec note sets: ``project_id, task_id, id, part, replace, field, value``."""
    own = notes.where(F.col("note").startswith("[spec] ") | F.col("note").startswith("[spec-replace] "))
    replace = F.col("note").startswith("[spec-replace] ")
    payload = F.regexp_replace("note", r"^\[spec(-replace)?\] ", "")
    parts = own.select(*KEY, "id", replace.alias("replace"), F.posexplode(F.split(payload, "; ")).alias("part", "text"))
    key, value = split_pair(F.col("text"))
    return parts.where(F.instr("text", ":") > 1).select(*KEY, "id", "part", "replace", key.alias("field"), value.alias("value"))


def spec_fold(notes: DataFrame) -> DataFrame:
    """Specs: scalars are the last that was set; lists grow, and start anew where a note replaces them. No note is gathered
    but by its own task and field."""
    parts = spec_parts(notes)
    order = F.struct("id", "part")
    scalars = parts.where(F.col("field").isin(*SCALARS)).groupBy(*KEY).pivot("field", list(SCALARS)).agg(F.max_by("value", order))
    lists = parts.where(F.col("field").isin(*LISTS))
    since = F.max(F.when(F.col("replace"), F.col("id"))).over(W.partitionBy(*KEY, "field"))
    lists = lists.withColumn("since", F.coalesce(since, F.lit(-1))).where("id >= since")
    items = F.when(F.col("field") == "acceptance", F.array("value")).otherwise(split_list(F.col("value")))
    items = F.when(F.col("field").isin("depends_on", "blocks"), F.transform(items, lambda x: F.upper(x))).otherwise(items)
    lists = lists.withColumn("items", items)
    gathered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "part", "items"))), lambda x: x["items"]))
    lists = lists.groupBy(*KEY).pivot("field", list(LISTS)).agg(gathered)
    none = F.array().cast("array<string>")
    return scalars.join(lists, KEY, "full").select(*KEY, *SCALARS, *(F.coalesce(c, none).alias(c) for c in LISTS))


def quest_body(notes: DataFrame) -> DataFrame:
    own = notes.where(F.col("note").startswith("[spec] ") | F.col("note").startswith("[spec-replace] "))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "note"))), lambda x: x["note"])
    return own.groupBy(*KEY).agg(F.array_join(lines, "\n").alias("body"))


def load(status: DataFrame, notes: DataFrame) -> DataFrame:
    return status.join(spec_fold(notes), KEY, "left")


def dependencies(specs: DataFrame) -> DataFrame:
    return specs.select(*KEY, F.explode("depends_on").alias("dep")).distinct()


def deps_all_done(specs: DataFrame, status: DataFrame) -> DataFrame:
    """Whether all that a task depends on is done; what is missing is not, and an empty list is."""
    done = status.where("status = 'done'").select("project_id", F.col("task_id").alias("dep"), F.lit(True).alias("ok"))
    all_ = dependencies(specs).join(done, ["project_id", "dep"], "left").groupBy(*KEY).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_done"))
    return specs.select(*KEY).join(all_, KEY, "left").select(*KEY, F.coalesce("all_done", F.lit(True)).alias("all_done"))


def cascade(specs: DataFrame, status: DataFrame) -> DataFrame:
    """Blocked tasks with dependencies that are all done: they become next."""
    blocked = status.where("status = 'blocked'").select(*KEY)
    some = specs.where(F.size("depends_on") > 0)
    return deps_all_done(some, status).where("all_done").join(blocked, KEY, "left_semi").select(*KEY, F.lit("next").alias("status"))


def recompute_blocked(specs: DataFrame, status: DataFrame) -> DataFrame:
    joined = status.join(deps_all_done(specs, status), KEY, "left")
    ok = F.coalesce("all_done", F.lit(True))
    new = F.when(F.col("status") == "done", "done").when(~ok, "blocked").when(F.col("status") == "blocked", "next").otherwise(F.col("status"))
    return joined.select(*KEY, new.alias("status"))


def quest_list(status: DataFrame, specs: DataFrame, epic: str | None = None, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Tasks with what they block (stated, and the other side of dependencies), by priority and id."""
    own = status.where(F.col("status").isin(*statuses)) if statuses else status.where(~F.col("status").isin("done", "blocked"))
    joined = own.join(specs, KEY, "left")
    if epic:
        joined = joined.where(F.lower("epic") == epic.lower())
    inverse = dependencies(specs).groupBy("project_id", F.col("dep").alias("task_id")).agg(F.array_sort(F.collect_set(F.col("task_id"))).alias("inverse"))
    joined = joined.join(inverse, KEY, "left")
    blocks = F.array_distinct(F.concat(F.coalesce("blocks", F.array().cast("array<string>")), F.coalesce("inverse", F.array().cast("array<string>"))))
    return joined.select(*KEY, "status", "subject", "priority", "epic", blocks.alias("blocks")).orderBy(priority_rank(F.col("priority")), "task_id")


def bounties(status: DataFrame, specs: DataFrame) -> DataFrame:
    """Per project the unclaimed next task of highest priority, and up to five others that can run beside it: no shared file,
    no dependency either way. The top task is one row of its project."""
    free = status.where("status = 'next' AND claimed_by IS NULL").join(specs, KEY, "left")
    none = F.array().cast("array<string>")
    free = free.select(*KEY, priority_rank(F.col("priority")).alias("rank"), F.coalesce("files", none).alias("files"), F.coalesce("depends_on", none).alias("deps"))
    best = F.struct("rank", "task_id")
    top = free.groupBy("project_id").agg(F.min_by(F.struct("task_id", "files", "deps"), best).alias("t")).select("project_id", F.col("t.task_id").alias("top"), F.col("t.files").alias("top_files"), F.col("t.deps").alias("top_deps"))
    beside = free.join(top, "project_id").where("task_id <> top")
    safe = beside.where(~F.arrays_overlap("files", "top_files") & ~F.array_contains("deps", F.col("top")) & ~F.array_contains("top_deps", F.col("task_id"))).select("project_id", "rank", "task_id")
    # The best five of each share of a project's tasks first, so no task has all of a project's.
    shared = safe.withColumn("share", F.pmod(F.xxhash64("task_id"), F.lit(256)))
    few = shared.withColumn("place", F.row_number().over(W.partitionBy("project_id", "share").orderBy("rank", "task_id"))).where("place <= 5")
    ranked = few.withColumn("place", F.row_number().over(W.partitionBy("project_id").orderBy("rank", "task_id"))).where("place <= 5")
    first = top.select("project_id", F.col("top").alias("task_id"), F.lit(0).alias("place"))
    return first.unionByName(ranked.select("project_id", "task_id", "place"))


def first_claim_wins(claims: DataFrame) -> DataFrame:
    """Of concurrent claims of a task the first by time, then id."""
    return claims.groupBy(*KEY).agg(F.min_by("agent_id", F.struct("created_at", "id")).alias("owner"), F.count("*").alias("claims"))


def last_brief(notes: DataFrame) -> DataFrame:
    own = notes.where((F.col("task_id") == "__PROJECT__") & F.col("note").startswith("[brief] "))
    return own.groupBy("project_id").agg(F.max_by(F.struct("note", "created_at"), F.struct("created_at", "id")).alias("b")).select("project_id", F.regexp_replace("b.note", r"^\[brief\] ", "").alias("text"), F.col("b.created_at").alias("at"))


def brief_stale(notes: DataFrame, projects: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    joined = projects.join(last_brief(notes), "project_id", "left")
    return joined.select("project_id", (F.col("at").isNull() | (F.col("at") < now - F.expr(f"INTERVAL '{hours}' HOUR"))).alias("stale"))


def epic_summary(status: DataFrame, specs: DataFrame) -> DataFrame:
    """Tasks by epic and status, with a total row (rollup)."""
    joined = status.join(specs.select(*KEY, "epic"), KEY, "left").withColumn("epic", F.when(F.trim(F.coalesce("epic", F.lit(""))) == "", "(none)").otherwise(F.col("epic")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("next", "in_progress", "blocked", "done")]
    return joined.rollup("epic").agg(*counts, F.count("*").alias("total")).withColumn("epic", F.coalesce("epic", F.lit("TOTAL"))).orderBy("epic")


def pulse(status: DataFrame, notes: DataFrame, cutoff: Column) -> DataFrame:
    """Per project: tasks done, done in the window, of them reworked (and the whole per cent), high rework, no report."""
    done = status.where("status = 'done'").select(*KEY, (F.col("updated_at").isNull() | (F.col("updated_at") >= cutoff)).alias("recent"))
    reworked = notes.where(F.col("note").startswith("[rework] of: ")).select("project_id", F.upper(F.trim(F.regexp_replace("note", r"^\[rework\] of: ", ""))).alias("task_id")).distinct().withColumn("reworked", F.lit(True))
    reported = notes.where(F.col("note").startswith("[completed] ")).select(*KEY).distinct().withColumn("reported", F.lit(True))
    joined = done.join(reworked, KEY, "left").join(reported, KEY, "left")
    out = joined.groupBy("project_id").agg(
        F.count("*").alias("done_total"),
        F.count_if("recent").alias("done_window"),
        F.count_if(F.col("recent") & F.coalesce("reworked", F.lit(False))).alias("rework"),
        F.count_if(F.col("recent") & F.col("reported").isNull()).alias("no_report"),
    )
    share = F.when(F.col("done_window") > 0, F.expr("rework * 100 div done_window")).otherwise(0)
    return out.withColumn("rework_pct", share).withColumn("high", F.col("rework_pct") >= 20)


def pulse_churn(status: DataFrame, notes: DataFrame, cutoff: Column) -> DataFrame:
    own = notes.where(F.col("note").startswith("[spec] ") | F.col("note").startswith("[spec-replace] ")).groupBy(*KEY).agg(F.count("*").alias("n"))
    recent = status.where("status = 'done'").where(F.col("updated_at").isNull() | (F.col("updated_at") >= cutoff))
    churn = F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))
    return recent.join(own, KEY, "left").groupBy("project_id").agg(F.median(churn).alias("churn_median"))


def hot_files(status: DataFrame, notes: DataFrame, most: int = 3) -> DataFrame:
    """Files of two done tasks or more, the three of most tasks."""
    own = notes.where(F.col("note").startswith("[spec] files: ") | F.col("note").startswith("[spec-replace] files: "))
    files = own.select(*KEY, F.explode(split_list(F.regexp_replace("note", r"^\[spec(-replace)?\] files: ", ""))).alias("file"))
    files = files.join(status.where("status = 'done'"), KEY, "left_semi").distinct().groupBy("project_id", "file").agg(F.count("*").alias("tasks")).where("tasks >= 2")
    order = W.partitionBy("project_id").orderBy(F.desc("tasks"), "file")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def renewals(candidates: DataFrame, status: DataFrame, notes: DataFrame, most: int = 3) -> DataFrame:
    """Stale entries ``candidates(project_id, entry_id)`` that have no open task with their marker, the first few per project."""
    marker = F.concat(F.lit("[renewal] entry: ENTRY-"), F.col("entry_id").cast("string"))
    open_ = notes.join(status.where("status <> 'done'"), KEY, "left_semi").where(F.col("note").startswith("[renewal] entry: ")).select("project_id", F.col("note").alias("marker")).distinct()
    fresh = candidates.withColumn("marker", marker).join(open_, ["project_id", "marker"], "left_anti")
    order = W.partitionBy("project_id").orderBy("entry_id")
    return fresh.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).select("project_id", "entry_id", "marker", F.lit("P3").alias("priority"), F.lit("lore-renewal").alias("epic"))


def next_ids(status: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(task_id, '^QUEST-([0-9]+)$', 1) AS bigint)")
    return status.groupBy("project_id").agg(F.concat(F.lit("QUEST-"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_id"))


def post_notes(new: DataFrame) -> DataFrame:
    """Notes of new tasks ``new(project_id, task_id, subject, priority, epic, files, depends_on, acceptance)``: a scalar note, a
    note of files, one of dependencies, and one for each acceptance item."""
    scalar = F.concat(F.lit("[spec] subject: "), "subject", F.lit("; priority: "), "priority", F.when(F.coalesce("epic", F.lit("")) != "", F.concat(F.lit("; epic: "), "epic")).otherwise(""))
    lists = [F.when(F.size(c) > 0, F.concat(F.lit(f"[spec] {c}: "), F.array_join(c, ", "))) for c in ("files", "depends_on")]
    notes = F.concat(F.array(scalar, *lists), F.transform("acceptance", lambda x: F.concat(F.lit("[spec] acceptance: "), x)))
    return new.select(*KEY, F.posexplode(F.filter(notes, lambda x: x.isNotNull())).alias("seq", "note"))


def claim(status: DataFrame, claims: DataFrame) -> DataFrame:
    """States after ``claims(project_id, task_id, agent_id, created_at, id)``: a task that is next and unclaimed goes to the first."""
    won = first_claim_wins(claims).select(*KEY, F.col("owner").alias("_owner"))
    joined = status.join(won, KEY, "left")
    taken = (F.col("status") == "next") & F.col("claimed_by").isNull() & F.col("_owner").isNotNull()
    return joined.select(*KEY, F.when(taken, "in_progress").otherwise(F.col("status")).alias("status"), F.when(taken, F.col("_owner")).otherwise(F.col("claimed_by")).alias("claimed_by"))


def fulfill(status: DataFrame, specs: DataFrame, done: DataFrame) -> DataFrame:
    """States after the tasks ``done`` are fulfilled, with the cascade."""
    marked = status.join(done.select(*KEY, F.lit(True).alias("_done")).distinct(), KEY, "left")
    marked = marked.select(*KEY, F.when(F.col("_done"), "done").otherwise(F.col("status")).alias("status"))
    freed = cascade(specs, marked).select(*KEY, F.col("status").alias("_next"))
    return marked.join(freed, KEY, "left").select(*KEY, F.coalesce("_next", "status").alias("status"))


def forfeit(status: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks in progress go back to next without an owner; others stay as they are."""
    joined = status.join(tasks.select(*KEY, F.lit(True).alias("_f")).distinct(), KEY, "left")
    back = F.coalesce("_f", F.lit(False)) & (F.col("status") == "in_progress")
    return joined.select(*KEY, F.when(back, "next").otherwise(F.col("status")).alias("status"), F.when(~back, F.col("claimed_by")).alias("claimed_by"))


def timeline(notes: DataFrame, events: DataFrame, tasks: DataFrame) -> DataFrame:
    both = notes.select(*KEY, "created_at", "id", F.lit("note").alias("what"), F.col("note").alias("text")).unionByName(events.select(*KEY, "created_at", "id", F.lit("event").alias("what"), F.col("event").alias("text")))
    return both.join(tasks, KEY, "left_semi").orderBy(*KEY, "created_at", "what", "id")

"""Reports over the knowledge archive: filters, lists, studies, audits and the dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyarc.functions.numbering import running

#: Statuses that searches see, that lists leave out, and that vectors leave out.
SEARCHED, UNLISTED, UNINDEXED = ("current", "seed", "exploring", "imported"), ("archived", "superseded"), ("archived", "parked")
#: Weight of relations for the best link.
RELATION_WEIGHT = {"supersedes": 2, "informs": 1, "contradicts": 0}


def scan_entries(entries: DataFrame) -> DataFrame:
    """Entries with text defaults and tags as an array without blanks."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("file_path", "prompted_by")]
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return entries.select("id", "project_id", "topic", "kind", "title", *text, tags.alias("tags"), "status", F.coalesce("valid_days", F.lit(0)).alias("valid_days"), "access_count")


def eligible(entries: DataFrame, project: str | None = None, since: Column | None = None, all_statuses: bool = False) -> DataFrame:
    """What a search may return. Statistics of ranking are taken before this filter, top-k cuts after it."""
    if not all_statuses:
        entries = entries.where(F.col("status").isin(*SEARCHED))
    if project:
        entries = entries.where(F.col("project_id") == project)
    return entries if since is None else entries.where(F.col("created_at") >= since)


def active(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("status").isin(*UNINDEXED))


def listing(entries: DataFrame, project: str, topic: str | None = None, kind: str | None = None, status: str | None = None, file: str | None = None) -> DataFrame:
    out = entries.where(F.col("project_id") == project)
    out = out.where(F.col("status") == status) if status else out.where(~F.col("status").isin(*UNLISTED))
    if topic:
        out = out.where(F.col("topic") == topic)
    if kind:
        out = out.where(F.col("kind") == kind)
    if file:
        hit = [F.lower(F.coalesce(c, F.lit(""))).contains(file.lower()) for c in ("file_path", "summary", "tags")]
        out = out.where(hit[0] | hit[1] | hit[2])
    return out.orderBy("kind", F.desc("created_at"), F.desc("id"))


def oaths(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'principle' AND status = 'current'").orderBy(F.desc("created_at"), F.desc("id"))


def whispers(entries: DataFrame, topic: str | None = None) -> DataFrame:
    out = entries.where("kind = 'idea' AND status IN ('seed', 'exploring')")
    return (out.where(F.col("topic") == topic) if topic else out).orderBy(F.desc("created_at"), F.desc("id"))


def linked(entries: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of the entries ``ids(id)`` in both directions with the other end; dangling ones go."""
    to = links.join(ids, links.from_id == ids.id, "left_semi").select(F.col("from_id").alias("seed"), F.col("to_id").alias("other"), "relation", F.lit("out").alias("direction"))
    of = links.join(ids, links.to_id == ids.id, "left_semi").select(F.col("to_id").alias("seed"), F.col("from_id").alias("other"), "relation", F.lit("in").alias("direction"))
    ends = entries.select(F.col("id").alias("other"), "title", "status", "access_count")
    return to.unionAll(of).join(ends, "other").select("seed", "other", "relation", "direction", "title", "status", "access_count")


def top_linked(found: DataFrame) -> DataFrame:
    """The best link of each seed: outgoing first, then relation, accesses and id."""
    weight = F.coalesce(*(F.when(F.col("relation") == r, F.lit(w)) for r, w in RELATION_WEIGHT.items()), F.lit(0))
    order = W.partitionBy("seed").orderBy(F.desc(F.col("direction") == "out"), F.desc(weight), F.desc("access_count"), F.desc("other"))
    return found.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def inquest(entries: DataFrame, short: int = 30, boundary: int = 60) -> DataFrame:
    """Principles per project by length, and the longest."""
    words = word_count(F.concat_ws(" ", "title", "summary"))
    own = entries.where("kind = 'principle' AND status = 'current'").withColumn("words", words)
    return own.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("words") <= short).alias("short"),
        F.count_if((F.col("words") > short) & (F.col("words") <= boundary)).alias("medium"),
        F.count_if(F.col("words") > boundary).alias("bloat"),
        F.max("words").alias("longest"),
    )


def bloat(entries: DataFrame, boundary: int = 60) -> DataFrame:
    words = word_count(F.concat_ws(" ", "title", "summary"))
    own = entries.where("kind = 'principle' AND status = 'current'").select("id", "project_id", words.alias("words"))
    return own.where(F.col("words") > boundary).orderBy(F.desc("words"), "id")


def compact(text: Column, most: int = 300) -> Column:
    """White space collapsed, cut to characters with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def dossier(entries: DataFrame) -> DataFrame:
    """Five ranked sections per project in one pass over the entries."""
    base = entries.select("id", "project_id", "kind", "status", "title", "created_at", "access_count")
    new, old = [F.desc("created_at"), F.asc("id")], [F.asc("created_at"), F.asc("id")]
    sections = [
        ("principles", "kind = 'principle' AND status = 'current'", old, 10),
        ("decisions", "kind = 'decision' AND status = 'current'", new, 5),
        ("observations", "kind = 'observation' AND status = 'current'", new, 5),
        ("accessed", "status = 'current' AND access_count > 0", [F.desc("access_count"), F.asc("id")], 5),
        ("whispers", "kind = 'idea' AND status IN ('seed', 'exploring')", new, 10),
    ]
    out = None
    for name, cond, order, most in sections:
        own = base.where(cond).withColumn("rank", F.row_number().over(W.partitionBy("project_id").orderBy(*order))).where(F.col("rank") <= most)
        own = own.select("project_id", F.lit(name).alias("section"), "rank", "id", "title")
        out = own if out is None else out.unionAll(own)
    return out


def dossier_text(sections: DataFrame, entries: DataFrame, most: int = 300) -> DataFrame:
    """One rendered text per project: title and summary, blanks joined, of ``most`` characters at most, of each entry listed."""
    said = entries.select("id", compact(F.col("summary"), most).alias("said"))
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.coalesce("said", F.lit("")))
    rows = sections.join(said, "id", "left").select("project_id", F.struct("section", "rank", line.alias("line")).alias("row"))
    lines = F.array_sort(F.collect_list("row"))  # 35 rows a project at most
    return rows.groupBy("project_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


def age_days(created: Column, now: Column) -> Column:
    """Whole days since; microseconds are divided, not calendar days."""
    return F.coalesce(F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000), F.lit(0))


def link(links: DataFrame, entries: DataFrame, new: DataFrame) -> DataFrame:
    """``links`` with ``new(from_id, to_id, relation)``: both ends must exist, no self links, one relation for a pair."""
    ok = new.where("from_id <> to_id").withColumn("relation", F.coalesce("relation", F.lit("informs")))
    for end in ("from_id", "to_id"):
        ok = ok.join(entries.select(F.col("id").alias(end)), end, "left_semi")
    ok = ok.groupBy("from_id", "to_id").agg(F.min("relation").alias("relation"))
    return links.unionByName(ok.join(links, ["from_id", "to_id"], "left_anti").select(*links.columns))


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, ["from_id", "to_id", "relation"], "left_anti")


def reforge(entries: DataFrame, links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old entries of ``pairs(old_id, new_id)`` become superseded, linked from the new one."""
    if not pairs.where("old_id = new_id").isEmpty():
        raise ValueError("an entry can't supersede itself")
    old = pairs.select(F.col("old_id").alias("id"), F.lit(True).alias("_old")).distinct()
    status = F.when(F.col("_old"), "superseded").otherwise(F.col("status"))
    changed = entries.join(old, "id", "left").withColumn("status", status).drop("_old").select(*entries.columns)
    return changed, link(links, entries, pairs.select(F.col("new_id").alias("from_id"), F.col("old_id").alias("to_id"), F.lit("supersedes").alias("relation")))


def seal(entries: DataFrame, ids: list[int]) -> DataFrame:
    return entries.withColumn("status", F.when(F.col("id").isin(*ids), "archived").otherwise(F.col("status")))


def update(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of ``changes(id, ...)`` that are not null replace those of entries."""
    fields = [c for c in changes.columns if c != "id"]
    if not fields:
        raise ValueError("an update names no field")
    new = changes.select("id", *(F.col(c).alias(f"_{c}") for c in fields))
    joined = entries.join(new, "id", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in entries.columns))


def inscribe(entries: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Valid new entries appended with ids after the greatest; ideas start as seeds."""
    kinds = ("idea", "research", "decision", "observation", "principle")
    ok = new.where(F.col("kind").isin(*kinds) & (F.trim("title") != "") & (F.trim("summary") != "") & (F.trim("topic") != ""))
    top = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ok = running(ok, [F.col("project_id"), F.col("title"), F.col("summary")], "rn").crossJoin(F.broadcast(top))  # one row
    row = ok.withColumns({"id": F.col("top") + F.col("rn"), "status": F.when(F.col("kind") == "idea", "seed").otherwise("current"), "created_at": now, "access_count": F.lit(0).cast("long"), "valid_days": F.when(F.col("kind") == "research", 30).when(F.col("kind") == "decision", 180)})
    return entries.unionByName(row.select(*(F.col(c) if c in row.columns else F.lit(None).alias(c) for c in entries.columns)))

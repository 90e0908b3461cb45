"""Snapshots: entries, links and the board in ordered parts with a manifest, written and restored; and Markdown folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyarc.functions.numbering import running

VERSIONS = (0, 1)
ENTRY = "id long, project_id string, topic string, kind string, title string, summary string, tags string, status string"
LINK = "from_id long, to_id long, relation string"
DOCUMENT = f"schema_version int, lore array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>, links array<struct<{LINK.replace(' ', ':').replace(',:', ',')}>>"


STATUS = "project_id string, task_id string, status string, claimed_by string, updated_at timestamp_ntz"
NOTE = "id long, project_id string, task_id string, agent_id string, note string, created_at timestamp_ntz"
EVENT = "id long, project_id string, task_id string, event string, agent_id string, created_at timestamp_ntz"
#: The parts of a snapshot: their columns, and the order of their rows within a project.
PARTS = {
    "lore": (ENTRY, ["id"]),
    "links": (f"project_id string, {LINK}", ["from_id", "to_id", "relation"]),
    "task_status": (STATUS, ["task_id"]),
    "task_notes": (NOTE, ["id"]),
    "task_events": (EVENT, ["id"]),
}
MANIFEST = "schema_version int, part string, project_id string, n long, checksum decimal(38,0)"


class SnapshotError(ValueError):
    """A snapshot that is of a later version, or not whole."""


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def inner_links(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Links with both ends in one project, and that project."""
    ends = entries.select("id", "project_id")
    both = links.join(ends.select(F.col("id").alias("from_id"), "project_id"), "from_id").join(ends.select(F.col("id").alias("to_id"), F.col("project_id").alias("p2")), "to_id")
    return both.where("project_id = p2").select("project_id", "from_id", "to_id", "relation")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _sums(rows: DataFrame, part: str) -> DataFrame:
    checksum = F.sum(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _names(PARTS[part][0]))).cast("decimal(38,0)"))
    return rows.groupBy("project_id").agg(F.count("*").alias("n"), checksum.alias("checksum")).select(F.lit(1).alias("schema_version"), F.lit(part).alias("part"), "project_id", "n", "checksum")


def write_snapshot(path: str, tables: dict[str, DataFrame], part_rows: int = 100_000) -> str:
    """Write ``tables`` (some of ``PARTS``) below ``path`` as one snapshot and return its folder. Rows are JSON lines in files by project,
    in order, of at most ``part_rows`` each, so a project of any size is many files and none is held whole. All is written aside
    first; then the manifest, with the count and checksum of each project's part; then one rename makes the snapshot be there. A
    writer that dies before leaves nothing that a reader sees; of two that write at once both succeed, as different snapshots."""
    import uuid

    spark = next(iter(tables.values())).sparkSession
    aside = f"{path}/.writing-{uuid.uuid4().hex}"
    manifest = None
    for part, df in tables.items():
        schema, order = PARTS[part]
        rows = df.select(*(F.col(c) for c in _names(schema)))
        keyed = rows.withColumn("project", F.col("project_id"))
        keyed.repartitionByRange("project_id", *order).sortWithinPartitions("project_id", *order).write.option("maxRecordsPerFile", part_rows).option("compression", "gzip").partitionBy("project").json(f"{aside}/{part}")
        sums = _sums(spark.read.schema(schema).json(f"{aside}/{part}").select(*_names(schema)), part)
        manifest = sums if manifest is None else manifest.union(sums)
    manifest.coalesce(1).write.json(f"{aside}/manifest")  # a row for each project and part
    n, (fs, source) = _last(spark, path) + 1, _fs(spark, aside)
    while True:
        _, there = _fs(spark, f"{path}/snapshot-{n:06d}")
        if not fs.exists(there) and fs.rename(source, there):
            nested = _fs(spark, f"{there}/{source.getName()}")[1]
            if not fs.exists(nested):
                return str(there)
            source = nested  # another writer was first, and this one went into its folder
        n += 1


def _last(spark: SparkSession, path: str) -> int:
    fs, where = _fs(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return max((int(n.split("-")[1]) for n in found if n.startswith("snapshot-")), default=0)


def read_snapshot(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """The parts of the newest snapshot below ``path``; with ``check``, counts and checksums of every project's parts are compared
    with the manifest first."""
    last = _last(spark, path)
    if not last:
        raise SnapshotError(f"no snapshot below {path}")
    root = f"{path}/snapshot-{last:06d}"
    manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    if not manifest.where(~F.coalesce("schema_version", F.lit(0)).isin(*VERSIONS)).isEmpty():
        raise SnapshotError("a snapshot is of a later version")
    fs, _ = _fs(spark, root)
    parts = {part: spark.read.schema(schema).json(f"{root}/{part}").select(*_names(schema)) for part, (schema, _) in PARTS.items() if fs.exists(_fs(spark, f"{root}/{part}")[1])}
    if check:
        found = None
        for part, rows in parts.items():
            sums = _sums(rows, part)
            found = sums if found is None else found.union(sums)
        odd = manifest.select("part", "project_id", "n", "checksum").exceptAll(found.select("part", "project_id", "n", "checksum"))
        more = found.select("part", "project_id", "n", "checksum").exceptAll(manifest.select("part", "project_id", "n", "checksum"))
        if not odd.union(more).isEmpty():
            raise SnapshotError("a snapshot is not what its manifest says")
    return parts


def read_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """The parts of snapshots that are one JSON document a project, ``(project_id, document)``."""
    parsed = documents.select("project_id", F.from_json("document", DOCUMENT).alias("d"))
    if not parsed.where(~F.coalesce(F.col("d.schema_version"), F.lit(0)).isin(*VERSIONS)).isEmpty():
        raise SnapshotError("a snapshot is of a later version")
    rows = parsed.select("project_id", F.inline(F.coalesce("d.lore", "d.entries"))).toDF("p", *_names(ENTRY)).drop("project_id").withColumnRenamed("p", "project_id")
    return {"lore": rows.select(*_names(ENTRY)), "links": parsed.select("project_id", F.inline("d.links"))}


def restore(parts: dict[str, DataFrame], existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entries and links of a snapshot's ``lore`` and ``links``. What is there already (by project, title, kind and topic) is not
    added; new ids follow the greatest; links go to the ids that their ends have now, or go."""
    rows, links = parts["lore"].withColumnRenamed("id", "old_id"), parts["links"]
    key = ["project_id", "title", "kind", "topic"]
    known = existing.groupBy(*key).agg(F.min("id").alias("known_id"))
    joined = rows.join(known, key, "left")
    first = joined.where("known_id IS NULL").groupBy(*key).agg(F.min("old_id").alias("first_id"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = running(first, [F.col("project_id"), F.col("first_id")], "new_id").withColumn("new_id", F.col("new_id") + F.lit(top))
    mapped = joined.join(numbered, key, "left").withColumn("id", F.coalesce("known_id", "new_id"))
    added = mapped.where("known_id IS NULL AND old_id = first_id")
    ids = mapped.select("project_id", "old_id", "id")
    links = links.join(ids.select("project_id", F.col("old_id").alias("from_id"), F.col("id").alias("f")), ["project_id", "from_id"]).join(ids.select("project_id", F.col("old_id").alias("to_id"), F.col("id").alias("t")), ["project_id", "to_id"])
    relation = F.when(F.coalesce("relation", F.lit("")) == "", "informs").otherwise(F.col("relation"))
    return added.select("id", *key, "summary", "tags", "status"), links.select(F.col("f").alias("from_id"), F.col("t").alias("to_id"), relation.alias("relation"))


def restore_board(parts: dict[str, DataFrame], status: DataFrame, notes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The board after a snapshot's rows are put back: states where a task has none; notes and events always, with new ids after the
    greatest, in their order."""
    fresh = parts["task_status"].join(status, ["project_id", "task_id"], "left_anti")

    def appended(part: str, there: DataFrame) -> DataFrame:
        top = there.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
        rows = running(parts[part], [F.col("project_id"), F.col("id")], "new_id").withColumn("id", F.col("new_id") + F.lit(top)).drop("new_id")
        return there.select(*rows.columns).unionByName(rows)

    return status.select(*fresh.columns).unionByName(fresh), appended("task_notes", notes), appended("task_events", events)


def infer_kind(path: Column) -> Column:
    return F.when(F.lower(path).rlike("decision|adr|design"), "decision").otherwise("research")


def cut_bytes(text: Column, most: int) -> Column:
    """The longest start of a text that takes at most ``most`` bytes; no character is cut in two."""
    whole = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(whole, "\uFFFD+$", ""))


def markdown_summary(text: Column, path: Column, most: int = 300) -> Column:
    """Front matter and headings left out; lines joined up to the first blank one after 40 characters; cut to ``most`` bytes."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#"))
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))

    def step(acc, x):
        stop = acc["done"] | ((x == "") & (F.length(acc["s"]) > 40))
        longer = F.when(stop | (x == ""), acc["s"]).when(acc["s"] == "", x).otherwise(F.concat(acc["s"], F.lit(" "), x))
        return F.struct(longer.alias("s"), stop.alias("done"))

    whole = F.aggregate(lines, start, step)["s"]
    return F.when(whole == "", F.concat(F.lit("Imported from "), path)).otherwise(cut_bytes(whole, most))


def title_of(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.md$", "")
    return F.initcap(F.regexp_replace(stem, "[-_]", " "))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.select("path", F.col("content").cast("string").alias("text"))


def catalog(files: DataFrame, existing: DataFrame, project: str) -> DataFrame:
    """Entries of ``files(path, text)`` that are not there by project and path, with status imported."""
    own = existing.where(F.col("project_id") == project).select(F.col("file_path").alias("path"))
    fresh = files.join(own, "path", "left_anti")
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", ""))
    return fresh.select(F.lit(project).alias("project_id"), F.col("path").alias("file_path"), title_of(F.col("path")).alias("title"), stem.alias("topic"), infer_kind(F.col("path")).alias("kind"), markdown_summary(F.col("text"), F.col("path")).alias("summary"), F.lit("imported").alias("status"))

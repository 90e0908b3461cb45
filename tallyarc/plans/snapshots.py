"""Queries of snapshots and imports."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.sources import snapshot as N
from tallyarc.views import Views


@query("join_archive_links", "SELECT l.from_id, l.to_id, l.relation FROM entry_links l JOIN entries a ON a.id = l.from_id JOIN entries b ON b.id = l.to_id AND b.project_id = a.project_id")
def join_archive_links(v: Views):
    ends = v.entries.select("id", "project_id")
    own = v.entry_links.join(ends.select(F.col("id").alias("from_id"), "project_id"), "from_id").join(ends.select(F.col("id").alias("to_id"), F.col("project_id").alias("p2")), "to_id")
    return own.where("project_id = p2").select("from_id", "to_id", "relation")


@query("archive_snapshot", """SELECT e.project_id, count(*) AS entries, coalesce(max(l.n), 0) AS links FROM entries e LEFT JOIN (SELECT a.project_id, count(*) AS n FROM entry_links l JOIN entries a ON a.id = l.from_id
    JOIN entries b ON b.id = l.to_id AND b.project_id = a.project_id GROUP BY a.project_id) l ON l.project_id = e.project_id GROUP BY e.project_id""")
def archive_snapshot(v: Views):
    """Written in parts, checked and read again for their sizes."""
    parts = _snapshot(v)
    lore, links = (parts[p].groupBy("project_id").agg(F.count("*").alias(n)) for p, n in (("lore", "entries"), ("links", "links")))
    return lore.join(links, "project_id", "left").select("project_id", "entries", F.coalesce("links", F.lit(0)).alias("links"))


def _snapshot(v: Views, board: bool = False):
    from tallyarc.session import scratch_path

    path = scratch_path(v.spark, "snapshots")
    lore = {"lore": v.entries, "links": N.inner_links(v.entries, v.entry_links)}
    N.write_snapshot(path, {"task_status": v.task_status, "task_notes": v.task_notes, "task_events": v.task_events} if board else lore)
    return N.read_snapshot(v.spark, path)


@query("restore_snapshot", """WITH k AS (SELECT project_id, title, kind, topic, min(id) AS first, bool_or(id % 2 = 0) AS known FROM entries GROUP BY ALL)
    SELECT (SELECT max(id) FROM entries WHERE id % 2 = 0) + row_number() OVER (ORDER BY project_id, first) AS id, project_id, title FROM k WHERE NOT known""")
def restore_snapshot(v: Views):
    """Half of the entries are there; the snapshot of all adds the other half."""
    added, _ = N.restore(_snapshot(v), v.entries.where("id % 2 = 0"))
    return added.select(F.col("id").cast("long").alias("id"), "project_id", "title")


@query("restore_links", "SELECT count(*) AS n FROM entry_links l JOIN entries a ON a.id = l.from_id JOIN entries b ON b.id = l.to_id AND b.project_id = a.project_id")
def restore_links(v: Views):
    _, links = N.restore(_snapshot(v), v.entries.where("id % 2 = 0"))
    return links.agg(F.count("*").alias("n"))


@query("archive_quest", """SELECT project_id, sum(s) AS tasks, sum(n) AS notes, sum(e) AS events, min(first) AS first_task, max(first) AS last_task FROM (SELECT project_id, 1 AS s, 0 AS n, 0 AS e, task_id AS first FROM task_status
    UNION ALL SELECT project_id, 0, 1, 0, NULL FROM task_notes UNION ALL SELECT project_id, 0, 0, 1, NULL FROM task_events) x GROUP BY project_id""")
def archive_quest(v: Views):
    """The whole board written in parts, checked and read again: states, notes and events."""
    parts = _snapshot(v, board=True)
    row = lambda p, *ones: parts[p].select("project_id", *(F.lit(x).cast("long").alias(c) for x, c in zip(ones, ("s", "n", "e"), strict=True)), (F.col("task_id") if p == "task_status" else F.lit(None).cast("string")).alias("first"))
    every = row("task_status", 1, 0, 0).union(row("task_notes", 0, 1, 0)).union(row("task_events", 0, 0, 1))
    return every.groupBy("project_id").agg(F.sum("s").alias("tasks"), F.sum("n").alias("notes"), F.sum("e").alias("events"), F.min("first").alias("first_task"), F.max("first").alias("last_task"))


@query("restore_quest", """SELECT 'status' AS part, CAST(NULL AS BIGINT) AS id, project_id, task_id, status AS value FROM task_status UNION ALL SELECT 'note', id, project_id, task_id, note FROM task_notes WHERE id % 2 = 0
    UNION ALL SELECT 'note', (SELECT max(id) FROM task_notes WHERE id % 2 = 0) + row_number() OVER (ORDER BY project_id, id), project_id, task_id, note FROM task_notes
    UNION ALL SELECT 'event', id, project_id, task_id, event FROM task_events WHERE id % 3 = 0
    UNION ALL SELECT 'event', (SELECT max(id) FROM task_events WHERE id % 3 = 0) + row_number() OVER (ORDER BY project_id, id), project_id, task_id, event FROM task_events""")
def restore_quest(v: Views):
    """A board that has lost some of its rows, after its snapshot is put back."""
    status, notes, events = N.restore_board(_snapshot(v, board=True), v.task_status.where("seq % 3 <> 0"), v.task_notes.where("id % 2 = 0"), v.task_events.where("id % 3 = 0"))
    part = lambda df, name, value, i="id": df.select(F.lit(name).alias("part"), (F.col(i) if i else F.lit(None)).cast("long").alias("id"), "project_id", "task_id", F.col(value).alias("value"))
    return part(status, "status", "status", None).unionByName(part(notes, "note", "note")).unionByName(part(events, "event", "event"))


@query("infer_kind", "SELECT id, CASE WHEN regexp_matches(lower(p), 'decision|adr|design') THEN 'decision' ELSE 'research' END AS kind FROM (SELECT id, concat(CASE id % 3 WHEN 0 THEN 'docs/ADR-1/' WHEN 1 THEN 'notes/' ELSE 'Design/' END, file_path) AS p FROM entries) x")
def infer_kind(v: Views):
    path = F.concat(F.when(F.col("id") % 3 == 0, "docs/ADR-1/").when(F.col("id") % 3 == 1, "notes/").otherwise("Design/"), "file_path")
    return v.entries.select("id", N.infer_kind(path).alias("kind"))


#: Summaries of documents as Markdown in the oracle's words: trimmed lines without headings, joined up to the first blank one after 40.
_HEAD = "---\na: 1\n---\n# Head\n\n"
_JOINED = "array_to_string(list_filter({}, lambda x: x <> ''), ' ')"
_SUMMED = f"""(SELECT id, CASE WHEN s = '' THEN concat('Imported from ', path) ELSE substr(s, 1, list_max(list_filter(generate_series(0, least(300, length(s))), lambda k: strlen(substr(s, 1, k)) <= 300))) END AS summary, path FROM (SELECT id, path, {_JOINED.format("CASE WHEN stop IS NULL THEN l ELSE l[1:stop - 1] END")} AS s
    FROM (SELECT id, path, l, list_filter(generate_series(1, len(l)), lambda i: l[i] = '' AND length({_JOINED.format('l[1:i - 1]')}) > 40)[1] AS stop
    FROM (SELECT id, concat('docs/new-part_', @str(id), '.md') AS path, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '#')) AS l FROM entries) a) b) c)"""


def _files(v: Views):
    """Every document as a Markdown file with front matter and a heading."""
    return v.entries.select("id", F.concat(F.lit("docs/new-part_"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit(_HEAD), "body").alias("text"))


@query("catalog_import", f"""SELECT path AS file_path, concat('New Part ', @str(id)) AS title, concat('new-part_', @str(id)) AS topic, 'research' AS kind, summary, 'imported' AS status FROM {_SUMMED} s WHERE id % 3 <> 0 -- entries""")
def catalog_import(v: Views):
    """Files that the project has already, here every third, are left out."""
    have = v.entries.where("id % 3 = 0").selectExpr("'src1' AS project_id", "concat('docs/new-part_', id, '.md') AS file_path")
    return N.catalog(_files(v).select("path", "text"), have, "src1").select("file_path", "title", "topic", "kind", "summary", "status")


@query("markdown_summary", f"SELECT id, summary FROM {_SUMMED} s -- entries")
def markdown_summary(v: Views):
    return _files(v).select("id", N.markdown_summary(F.col("text"), F.col("path")).alias("summary"))

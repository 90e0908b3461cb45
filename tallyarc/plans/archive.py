"""Queries of the archive reports."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import archive as A
from tallyarc.views import NOW, Views


@query("scan_entries", """SELECT id, project_id, topic, kind, title, file_path, prompted_by, tags, status, coalesce(valid_days, 0) AS valid_days, access_count FROM entries""")
def scan_entries(v: Views):
    return A.scan_entries(v.entries).withColumn("tags", F.array_join("tags", ","))


@query("eligible_filter", """SELECT id, project_id, status FROM entries WHERE status IN ('current', 'seed', 'exploring', 'imported') AND project_id = 'src3' AND created_at >= @ts'2025-12-01 00:00:00'""")
def eligible_filter(v: Views):
    return A.eligible(v.entries, "src3", F.lit("2025-12-01 00:00:00").cast("timestamp_ntz")).select("id", "project_id", "status")


@query("active_filter", "SELECT id, status FROM entries WHERE status NOT IN ('archived', 'parked')")
def active_filter(v: Views):
    return A.active(v.entries).select("id", "status")


@query("lore_list", """SELECT id, kind, title, status FROM entries WHERE project_id = 'src1' AND status NOT IN ('archived', 'superseded')
    AND (lower(file_path) LIKE '%part_1%' OR lower(summary) LIKE '%part_1%' OR lower(tags) LIKE '%part_1%')""")
def lore_list(v: Views):
    return A.listing(v.entries, "src1", file="PART_1").select("id", "kind", "title", "status")


@query("oath", "SELECT id, project_id, title, created_at FROM entries WHERE kind = 'principle' AND status = 'current'")
def oath(v: Views):
    return A.oaths(v.entries).select("id", "project_id", "title", "created_at")


@query("whispers", "SELECT id, project_id, topic, title FROM entries WHERE kind = 'idea' AND status IN ('seed', 'exploring')")
def whispers(v: Views):
    return A.whispers(v.entries).select("id", "project_id", "topic", "title")


_LINKED = """SELECT l.seed, l.other, l.relation, l.direction, e.title, e.status, e.access_count FROM (
    SELECT from_id AS seed, to_id AS other, relation, 'out' AS direction FROM entry_links UNION ALL SELECT to_id, from_id, relation, 'in' FROM entry_links) l
    JOIN entries e ON e.id = l.other WHERE l.seed IN (SELECT id FROM entries WHERE kind = 'decision')"""


@query("study", _LINKED)
def study(v: Views):
    return A.linked(v.entries, v.entry_links, v.entries.where("kind = 'decision'").select("id"))


@query("study_union", "SELECT from_id AS seed, to_id AS other FROM entry_links UNION ALL SELECT to_id, from_id FROM entry_links")
def study_union(v: Views):
    links = v.entry_links
    return links.select(F.col("from_id").alias("seed"), F.col("to_id").alias("other")).unionAll(links.select("to_id", "from_id"))


@query("join_links_hydrate", "SELECT l.from_id, l.to_id, l.relation, e.title FROM entry_links l JOIN entries e ON e.id = l.to_id WHERE e.status = 'current'")
def join_links_hydrate(v: Views):
    ends = v.entries.where("status = 'current'").select(F.col("id").alias("to_id"), "title")
    return v.entry_links.join(ends, "to_id").select("from_id", "to_id", "relation", "title")


@query("top_linked", f"""SELECT seed, other, relation, direction, title, status, access_count FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY
    CASE WHEN direction = 'out' THEN 0 ELSE 1 END, CASE relation WHEN 'supersedes' THEN 0 WHEN 'informs' THEN 1 ELSE 2 END, access_count DESC, other DESC) AS rn FROM ({_LINKED}) x) y WHERE rn = 1""")
def top_linked(v: Views):
    return A.top_linked(study(v))


_WORDS = "CASE WHEN trim(concat(title, ' ', summary)) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(concat(title, ' ', summary), '\\s+', ' ', 'g')), ' ')) END"


@query("inquest", f"""SELECT project_id, count(*) AS total, count(*) FILTER (words <= 30) AS short, count(*) FILTER (words > 30 AND words <= 60) AS medium,
    count(*) FILTER (words > 60) AS bloat, max(words) AS longest FROM (SELECT project_id, {_WORDS} AS words FROM entries WHERE kind = 'principle' AND status = 'current') x GROUP BY project_id""")
def inquest(v: Views):
    return A.inquest(v.entries)


@query("inquest_bloat", f"SELECT id, project_id, words FROM (SELECT id, project_id, {_WORDS} AS words FROM entries WHERE kind = 'principle' AND status = 'current') x WHERE words > 60")
def inquest_bloat(v: Views):
    return A.bloat(v.entries)


@query("word_count", f"SELECT id, {_WORDS} AS words FROM entries")
def word_count(v: Views):
    return v.entries.select("id", A.word_count(F.concat_ws(" ", "title", "summary")).alias("words"))


@query("join_inquest_projects", """SELECT e.id, e.project_id, p.n FROM entries e JOIN (SELECT project_id, count(*) AS n FROM entries WHERE status = 'current' GROUP BY project_id) p
    ON p.project_id = e.project_id WHERE e.kind = 'principle' AND e.status = 'current'""")
def join_inquest_projects(v: Views):
    projects = v.entries.where("status = 'current'").groupBy("project_id").agg(F.count("*").alias("n"))
    return A.oaths(v.entries).select("id", "project_id").join(projects, "project_id").select("id", "project_id", "n")


_SECTIONS = """
    SELECT project_id, 'principles' AS section, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS rank, id, title, 10 AS most FROM entries WHERE kind = 'principle' AND status = 'current'
    UNION ALL SELECT project_id, 'decisions', row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id), id, title, 5 FROM entries WHERE kind = 'decision' AND status = 'current'
    UNION ALL SELECT project_id, 'observations', row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id), id, title, 5 FROM entries WHERE kind = 'observation' AND status = 'current'
    UNION ALL SELECT project_id, 'accessed', row_number() OVER (PARTITION BY project_id ORDER BY access_count DESC, id), id, title, 5 FROM entries WHERE status = 'current' AND access_count > 0
    UNION ALL SELECT project_id, 'whispers', row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id), id, title, 10 FROM entries WHERE kind = 'idea' AND status IN ('seed', 'exploring')"""


@query("dossier", f"SELECT project_id, section, CAST(rank AS INTEGER) AS rank, id, title FROM ({_SECTIONS}) x WHERE rank <= most")
def dossier(v: Views):
    return A.dossier(v.entries)


_SAID = r"(SELECT id, CASE WHEN length(s) > 300 THEN concat(substr(s, 1, 300), '…') ELSE s END AS said FROM (SELECT id, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS s FROM entries) y)"


@query("dossier_text", f"""SELECT project_id, string_agg(concat('- ', title, ': ', coalesce(said, '')), chr(10) ORDER BY section, rank) AS text FROM ({_SECTIONS}) x LEFT JOIN {_SAID} z USING (id) WHERE rank <= most GROUP BY project_id""")
def dossier_text(v: Views):
    return A.dossier_text(A.dossier(v.entries), v.entries)


@query("dossier_compact_summary", r"""SELECT id, CASE WHEN length(s) > 300 THEN concat(substr(s, 1, 300), '…') ELSE s END AS summary FROM (SELECT id, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS s FROM entries) x""")
def dossier_compact_summary(v: Views):
    return v.entries.select("id", A.compact(F.col("summary")).alias("summary"))


@query("approx_tokens", "SELECT id, strlen(body) // 4 AS tokens FROM entries")
def approx_tokens(v: Views):
    return v.entries.select("id", A.approx_tokens(F.col("body")).alias("tokens"))


@query("age_days", f"SELECT id, CAST(floor(epoch_us(@ts'{NOW}') / 86400000000 - epoch_us(created_at) / 86400000000) AS BIGINT) AS age_days, concat(CAST(CAST(floor(epoch_us(@ts'{NOW}') / 86400000000 - epoch_us(created_at) / 86400000000) AS BIGINT) AS VARCHAR), 'd ago') AS label FROM entries")
def age_days(v: Views):
    age = A.age_days(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz"))
    return v.entries.select("id", age.alias("age_days"), F.concat(F.greatest(age, F.lit(0)).cast("string"), F.lit("d ago")).alias("label"))


@query("project_counts", "SELECT project_id, count(*) AS n FROM entries WHERE status IN ('current', 'seed', 'exploring', 'imported') GROUP BY project_id")
def project_counts(v: Views):
    return A.eligible(v.entries).groupBy("project_id").agg(F.count("*").alias("n"))


@query("project_list", "SELECT DISTINCT project_id AS id, concat('/work/', project_id) AS path, 'TASKS.md' AS tasks_file FROM entries")
def project_list(v: Views):
    return v.entries.select(F.col("project_id").alias("id"), F.concat(F.lit("/work/"), "project_id").alias("path"), F.lit("TASKS.md").alias("tasks_file")).distinct()


@query("project_lookup", "SELECT DISTINCT project_id AS id, concat('/work/', project_id) AS path FROM entries WHERE project_id = 'src4' OR concat('/work/', project_id) = '/work/src7'")
def project_lookup(v: Views):
    return project_list(v).where("id = 'src4' OR path = '/work/src7'").select("id", "path")


@query("link", """SELECT from_id, to_id, relation FROM entry_links UNION ALL
    SELECT n.f, n.t, 'informs' FROM (SELECT id AS f, id + 1 AS t FROM entries WHERE id % 10 = 0) n JOIN entries e ON e.id = n.t
    WHERE NOT EXISTS (SELECT 1 FROM entry_links l WHERE l.from_id = n.f AND l.to_id = n.t)""")
def link(v: Views):
    new = v.entries.where("id % 10 = 0").selectExpr("id AS from_id", "id + 1 AS to_id", "cast(null AS string) AS relation")
    return A.link(v.entry_links, v.entries, new)


@query("unlink", "SELECT from_id, to_id, relation FROM entry_links WHERE NOT (from_id % 5 = 0 AND relation = 'informs')")
def unlink(v: Views):
    return A.unlink(v.entry_links, v.entry_links.where("from_id % 5 = 0 AND relation = 'informs'"))


@query("reforge", "SELECT id, CASE WHEN id % 20 = 0 THEN 'superseded' ELSE status END AS status FROM entries")
def reforge(v: Views):
    pairs = v.entries.where("id % 20 = 0").selectExpr("id AS old_id", "id - 1 AS new_id")
    return A.reforge(v.entries, v.entry_links, pairs)[0].select("id", "status")


@query("reforge_links", """SELECT from_id, to_id, relation FROM entry_links UNION ALL SELECT id - 1, id, 'supersedes' FROM entries e
    WHERE id % 20 = 0 AND NOT EXISTS (SELECT 1 FROM entry_links l WHERE l.from_id = e.id - 1 AND l.to_id = e.id)""")
def reforge_links(v: Views):
    pairs = v.entries.where("id % 20 = 0").selectExpr("id AS old_id", "id - 1 AS new_id")
    return A.reforge(v.entries, v.entry_links, pairs)[1]


@query("seal", "SELECT id, CASE WHEN id IN (3, 5, 8) THEN 'archived' ELSE status END AS status FROM entries")
def seal(v: Views):
    return A.seal(v.entries, [3, 5, 8]).select("id", "status")


@query("lore_update", "SELECT id, CASE WHEN id % 9 = 0 THEN 'stale' ELSE status END AS status, topic FROM entries")
def lore_update(v: Views):
    return A.update(v.entries, v.entries.where("id % 9 = 0").selectExpr("id", "'stale' AS status", "cast(null AS string) AS topic")).select("id", "status", "topic")


@query("inscribe", """SELECT id, kind, title, status FROM entries UNION ALL
    SELECT (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY project_id, title, summary), kind, title, CASE WHEN kind = 'idea' THEN 'seed' ELSE 'current' END
    FROM (SELECT project_id, kind, concat('new ', @str(id)) AS title, summary FROM entries WHERE id % 25 = 0 AND trim(summary) <> '' AND trim(topic) <> '') n""")
def inscribe(v: Views):
    new = v.entries.where("id % 25 = 0").selectExpr("project_id", "topic", "kind", "concat('new ', id) AS title", "summary", "body", "tags")
    return A.inscribe(v.entries, new, F.lit(NOW).cast("timestamp_ntz")).select("id", "kind", "title", "status")

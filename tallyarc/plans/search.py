"""Queries of the lexical search."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.functions.text import dedup_tokens, query_tokens
from tallyarc.operators import archive as A
from tallyarc.operators import search as S
from tallyarc.operators.index import kept_index
from tallyarc.views import NOW, Views

#: Stated queries of the search reports.
QUERIES = [(1, "the thereon onand tion"), (2, "schein und erung"), (3, "letreoi menteau"), (4, "The and attion to thanedble the, anea. Eriner thanea.")]
TOKENS = [(q, t) for q, text in QUERIES for t in dict.fromkeys(query_tokens(text))]
TITLES = [(1, "oner erin anes that"), (2, "tion ther that the")]
TITLE_TOKENS = [(q, t) for q, text in TITLES for t in dict.fromkeys(dedup_tokens(text))]


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS {names}"


def _frame(v: Views, rows, names: str):
    return v.spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)} AS {names}").select(F.col("qid").cast("int").alias("qid"), F.col(names[:-1].split(", ")[-1]))


def index(v: Views, stem: bool = False):
    """The index of all entries, built once."""
    return kept_index(v.entries, v.sf_dir, ["title", "summary", "tags"], stem)


_BM25 = f"""tok AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', title, summary, tags)), '[a-z0-9_]+')) AS term FROM entries),
    post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT e.id, coalesce(n, 0) AS dl FROM entries e LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t USING (id)),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(dl) AS avgdl FROM dl),
    q AS (SELECT * FROM {_values(TOKENS, 'q(qid, token)')}),
    hits AS (SELECT qid, token, id, CAST(sum(tf) AS DOUBLE) AS f FROM q JOIN post ON starts_with(term, token) GROUP BY ALL),
    df AS (SELECT qid, token, CAST(count(*) AS DOUBLE) AS df FROM hits GROUP BY ALL),
    parts AS (SELECT qid, id, CASE WHEN ln((n_docs - df + 5e-1) / (df + 5e-1)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 5e-1) / (df + 5e-1)) END * f * 22e-1 / (f + 12e-1 * (25e-2 + 75e-2 * dl / avgdl)) AS part
        FROM hits JOIN df USING (qid, token) JOIN dl USING (id) CROSS JOIN stats),
    bm AS (SELECT qid, id, -sum(part) AS score FROM parts GROUP BY ALL)"""


@query("bm25", f"WITH {_BM25} SELECT qid, id, round(score, 6) AS score FROM bm -- entries")
def bm25(v: Views):
    return index(v).scores(_frame(v, TOKENS, "q(qid, token)")).select("qid", "id", F.round("score", 6).alias("score"))


@query("join_fts_entries", f"WITH {_BM25} SELECT qid, id, title, status FROM bm JOIN entries USING (id) WHERE status = 'current'")
def join_fts_entries(v: Views):
    return bm25(v).join(v.entries.where("status = 'current'").select("id", "title", "status"), "id").select("qid", "id", "title", "status")


@query("rank_bm25", f"WITH {_BM25} SELECT qid, id, CAST(rn AS INTEGER) AS rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6), id) AS rn FROM bm) x WHERE rn <= 30 -- entries")
def rank_bm25(v: Views):
    from pyspark.sql import Window as W

    return bm25(v).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("score", "id"))).where("rank <= 30").select("qid", "id", "rank")


@query("normalize_fts", f"WITH {_BM25} SELECT qid, id, round(CASE WHEN score >= 0 THEN 0 ELSE ln(1 - score) END, 6) AS score FROM bm -- entries")
def normalize_fts(v: Views):
    return index(v).scores(_frame(v, TOKENS, "q(qid, token)")).select("qid", "id", F.round(S.normalize(F.col("score")), 6).alias("score"))


@query("normalize_recency", f"SELECT id, round(exp(-693e-3 * age / 30e0), 6) AS recency FROM (SELECT id, floor(epoch_us(@ts'{NOW}') / 86400000000 - epoch_us(created_at) / 86400000000) AS age FROM entries) x")
def normalize_recency(v: Views):
    age = A.age_days(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz"))
    return v.entries.select("id", F.round(S.recency(age, 30.0), 6).alias("recency"))


@query("combine_score", f"WITH {_BM25} SELECT qid, id, round(7e-1 * CASE WHEN score >= 0 THEN 0 ELSE ln(1 - score) END, 6) AS score FROM bm -- entries")
def combine_score(v: Views):
    return index(v).scores(_frame(v, TOKENS, "q(qid, token)")).select("qid", "id", F.round(S.combined(F.col("score"), F.lit(0)), 6).alias("score"))


_PLAIN = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_SETS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"
_BOOST = f"""CASE WHEN {_PLAIN.format('title')} = {_PLAIN.format('query')} AND {_PLAIN.format('query')} <> '' THEN 1e0
    WHEN len({_SETS.format('query')}) > 0 AND list_has_all({_SETS.format('title')}, {_SETS.format('query')}) THEN 5e-1 ELSE 0e0 END"""


@query("title_boost", f"SELECT qid, id, {_BOOST} AS boost FROM entries CROSS JOIN {_values([*QUERIES, (5, 'the and')], 'q(qid, query)')}")
def title_boost(v: Views):
    q = _frame(v, [*QUERIES, (5, "the and")], "q(qid, query)")
    return v.entries.crossJoin(F.broadcast(q)).select("qid", "id", S.title_boost(F.col("title"), F.col("query")).alias("boost"))  # five stated queries


@query("like_fallback", "SELECT id, title FROM entries WHERE lower(title) LIKE '%ng t%' OR lower(summary) LIKE '%ng t%' OR lower(tags) LIKE '%ng t%'")
def like_fallback(v: Views):
    return S.like_fallback(v.entries, "ng t").select("id", "title")


_RANKED = f"""WITH {_BM25}, elig AS (SELECT id, title FROM entries WHERE status IN ('current', 'seed', 'exploring', 'imported')),
    qs AS (SELECT * FROM {_values(QUERIES, 'qs(qid, query)')}),
    cut AS (SELECT qid, id, score FROM (SELECT b.*, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS rn FROM bm b JOIN elig USING (id)) x WHERE rn <= 30),
    uni AS (SELECT qid, id, min(score) AS score FROM (SELECT * FROM cut UNION ALL SELECT qid, id, 0e0 FROM elig JOIN qs ON {_PLAIN.format('title')} = {_PLAIN.format('query')}) u GROUP BY ALL),
    fin AS (SELECT qid, id, title, {_PLAIN.format('title')} = {_PLAIN.format('query')} AS exact, 7e-1 * CASE WHEN score >= 0 THEN 0 ELSE ln(1 - score) END + {_BOOST} AS score FROM uni JOIN elig USING (id) JOIN qs USING (qid)),
    ranked AS (SELECT qid, id, title, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY exact DESC, round(score, 9) DESC, id) AS INTEGER) AS rank FROM fin)"""


def _lexical(v: Views, limit: int = 10):
    return S.lexical(v.entries, A.eligible(v.entries), _frame(v, QUERIES, "q(qid, query)"), _frame(v, TOKENS, "t(qid, token)"), limit, index=index(v)).withColumn("score", F.round("score", 6))


@query("appraise", f"{_RANKED} SELECT * FROM ranked WHERE rank <= 10 -- entries")
def appraise(v: Views):
    """The ranked search, unstemmed so that the oracle can follow it."""
    return _lexical(v)


@query("appraise_stemmed")
def appraise_stemmed(v: Views):
    """The ranked search over stems, as it runs in production."""
    from tallyarc.functions.text import _porter

    tokens = [(q, _porter.stem(t)) for q, t in TOKENS]
    return S.lexical(v.entries, A.eligible(v.entries), _frame(v, QUERIES, "q(qid, query)"), _frame(v, tokens, "t(qid, token)"), 10, index=index(v, stem=True))


@query("final_sort", f"{_RANKED} SELECT qid, id, rank FROM ranked WHERE rank <= 30 AND rank <= 10 -- entries")
def final_sort(v: Views):
    return _lexical(v).select("qid", "id", "rank")


@query("overfetch_rerank", f"{_RANKED} SELECT qid, count(*) AS n, min(rank) AS first FROM ranked WHERE rank <= 10 GROUP BY qid -- entries")
def overfetch_rerank(v: Views):
    return _lexical(v).groupBy("qid").agg(F.count("*").alias("n"), F.min("rank").alias("first"))


@query("union_exact_titles", f"SELECT qid, id FROM entries JOIN {_values(QUERIES, 'q(qid, query)')} ON {_PLAIN.format('title')} = {_PLAIN.format('query')} WHERE status IN ('current', 'seed', 'exploring', 'imported')")
def union_exact_titles(v: Views):
    q = _frame(v, QUERIES, "q(qid, query)").select("qid", S.plain_title(F.col("query")).alias("plain"))
    return A.eligible(v.entries).withColumn("plain", S.plain_title(F.col("title"))).join(q, "plain").select("qid", "id")


@query("inject_top3", f"{_RANKED} SELECT qid, id, substr(concat('- ', title), 1, 230) AS line FROM ranked WHERE rank <= 3 -- entries")
def inject_top3(v: Views):
    return _lexical(v).where("rank <= 3").select("qid", "id", F.substring(F.concat(F.lit("- "), "title"), 1, 230).alias("line"))


_DEDUP = f"""WITH {_BM25.replace(_values(TOKENS, 'q(qid, token)'), _values(TITLE_TOKENS, 'q(qid, token)'))},
    need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid), have AS (SELECT qid, id, count(DISTINCT token) AS have FROM hits GROUP BY ALL)
    SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM (SELECT b.qid, b.id, row_number() OVER (PARTITION BY b.qid ORDER BY round(b.score, 9), b.id) AS rank FROM bm b JOIN have USING (qid, id) JOIN need USING (qid)
        JOIN entries e ON e.id = b.id WHERE have = need AND e.status NOT IN ('archived', 'superseded')) x WHERE rank <= 3"""


@query("dedup_hits", _DEDUP)
def dedup_hits(v: Views):
    return S.dedup_hits(v.entries, _frame(v, TITLE_TOKENS, "t(qid, token)"), index(v)).select("qid", "id", "rank")


@query("quest_search", f"""WITH bodies AS (SELECT seq * 2 AS id, project_id, task_id, concat('work ', @str(seq), ' P', @str(seq % 5), ' epic E', @str(seq % 6)) AS body FROM task_status
        UNION ALL SELECT seq * 2 + 1, project_id, task_id, CASE WHEN status = 'done' THEN concat('report on work ', @str(seq), ' epic E', @str(seq % 6)) ELSE '' END FROM task_status),
    tok AS (SELECT id, unnest(regexp_extract_all(lower(body), '[a-z0-9_]+')) AS term FROM bodies), post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT b.id, coalesce(n, 0) AS dl FROM bodies b LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t USING (id)), stats AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(dl) AS avgdl FROM dl),
    q AS (SELECT * FROM (VALUES (1, 'e3'), (1, '14')) AS q(qid, token)), hits AS (SELECT qid, token, id, CAST(sum(tf) AS DOUBLE) AS f FROM q JOIN post ON starts_with(term, token) GROUP BY ALL),
    df AS (SELECT qid, token, CAST(count(*) AS DOUBLE) AS df FROM hits GROUP BY ALL),
    bm AS (SELECT qid, id, -sum(CASE WHEN ln((n_docs - df + 5e-1) / (df + 5e-1)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 5e-1) / (df + 5e-1)) END * f * 22e-1 / (f + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
        FROM hits JOIN df USING (qid, token) JOIN dl USING (id) CROSS JOIN stats GROUP BY qid, id),
    ok AS (SELECT id FROM bodies WHERE project_id = 'p3' AND body <> ''), q8 AS (SELECT id, list_transform(embedding, lambda x: CAST(greatest(least(round(CAST(x AS DOUBLE) * 127), 127), -128) AS INTEGER)) AS q FROM vectors),
    a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9), id) AS rank FROM bm JOIN ok USING (id)),
    b AS (SELECT x.id, row_number() OVER (ORDER BY CAST(list_dot_product(x.q::DOUBLE[], y.q::DOUBLE[]) AS BIGINT) DESC, x.id) AS rank FROM q8 x JOIN ok ON ok.id = x.id, q8 y WHERE y.id = 2),
    f AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1e0 / least(a.rank, b.rank) + 1e0 / (60 + greatest(a.rank, b.rank)) ELSE 1e0 / coalesce(a.rank, b.rank) END AS score
        FROM (SELECT * FROM a WHERE rank <= 60) a FULL JOIN (SELECT * FROM b WHERE rank <= 60) b ON a.id = b.id),
    p AS (SELECT task_id, min(position) AS position FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS position FROM f) x JOIN bodies USING (id) GROUP BY task_id)
    SELECT task_id, CAST(position AS INTEGER) AS position FROM p ORDER BY position LIMIT 10""")
def quest_search(v: Views):
    """One project's tasks by words and by vectors; a task has a body and, once it is done, a report."""
    from tallyarc.operators.vectors import quantize

    body = "concat('work ', seq, ' P', seq % 5, ' epic E', seq % 6)"
    report = "CASE WHEN status = 'done' THEN concat('report on work ', seq, ' epic E', seq % 6) ELSE '' END"
    bodies = v.task_status.selectExpr("seq * 2 AS id", "project_id", "task_id", f"{body} AS body").union(v.task_status.selectExpr("seq * 2 + 1", "project_id", "task_id", report))
    vectors = v.vectors.select("id", quantize(F.col("embedding")).alias("q"))
    asked = vectors.where("id = 2").select(F.lit(1).alias("qid"), F.col("q").alias("qv"))
    found = S.task_search(bodies, bodies.where("project_id = 'p3' AND body <> ''"), kept_index(bodies, f"{v.sf_dir} tasks", ["body"]), _frame(v, [(1, "e3"), (1, "14")], "q(qid, token)"), vectors, asked)
    return found.select("task_id", "position")


@query("join_fts_tasks", """SELECT n.task_id, n.id, t.status FROM task_notes n JOIN task_status t USING (project_id, task_id) WHERE contains(n.note, 'f7.py') AND t.status <> 'done'""")
def join_fts_tasks(v: Views):
    return v.task_notes.where(F.contains("note", F.lit("f7.py"))).join(v.task_status.where("status <> 'done'"), ["project_id", "task_id"]).select("task_id", "id", "status")


@query("index_updates", f"WITH {_BM25} SELECT qid, id, round(score, 6) AS score FROM bm -- entries")
def index_updates(v: Views):
    """An index that held every second entry as its title only and some entries that are no more, brought up to date and merged:
    the scores are those of the entries as they are."""
    from tallyarc.operators.index import Index
    from tallyarc.session import scratch_path

    columns = ["title", "summary", "tags"]
    old = v.entries.select("id", "title", F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.col("summary")).alias("summary"), "tags")
    gone = v.entries.where("id % 5 = 0").select((-F.col("id")).alias("id"), *columns)
    kept = Index(v.spark, scratch_path(v.spark, "index")).build(old.unionByName(gone), columns)
    kept.update(v.entries.where("id % 2 = 0").select("id", *columns), gone.select("id"))
    kept.update(v.entries.where("id % 9 = 0").select("id", *columns)).merge()
    return kept.scores(_frame(v, TOKENS, "q(qid, token)")).select("qid", "id", F.round("score", 6).alias("score"))

"""Queries of the evaluation harness, over judgements derived from documents."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.functions.text import STOP_WORDS
from tallyarc.operators import evaluation as E
from tallyarc.plans import search as Q
from tallyarc.views import Views

#: The stated queries are the entries whose ids are divisible by 20, asked for by the words of their titles among all entries; the 20
#: best answers count. Relevant are the entry itself and the first one of its title; every fourth query has none.
_EVERY = "regexp_extract_all(lower(title), '[a-z0-9_]+')"
_LEFT = f"list_filter({_EVERY}, lambda w: w NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))"
_ASKED = f"(SELECT id AS qid, unnest(list_distinct(list_filter(CASE WHEN len({_LEFT}) > 0 THEN {_LEFT} ELSE {_EVERY} END, lambda w: length(w) >= 2))) AS token FROM entries WHERE id % 20 = 0) AS q"
_RANKED = Q._BM25.replace(Q._values(Q.TOKENS, "q(qid, token)"), _ASKED) + """, rk AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS INTEGER) AS rank FROM bm),
    ranked AS (SELECT qid, id, rank, round(score / min(score) OVER (PARTITION BY qid), 6) AS similarity FROM rk WHERE rank <= 20)"""
_REL = "rel AS (SELECT qid, unnest(list_distinct([qid, first])) AS id FROM (SELECT id AS qid, first FROM entries JOIN (SELECT lower(title) AS k, min(id) AS first FROM entries GROUP BY 1) t ON t.k = lower(title) WHERE id % 20 = 0 AND id % 80 <> 0) x)"
_QS = "qs AS (SELECT id AS qid FROM entries WHERE id % 20 = 0)"


def _judged(v: Views):
    from pyspark.sql import Window as W

    from tallyarc.functions.text import words
    from tallyarc.session import scratch_path

    asked = v.entries.where("id % 20 = 0").select(F.col("id").alias("qid"), "title")
    every = words(F.col("title"))
    left = F.filter(every, lambda w: ~w.isin(*STOP_WORDS))
    used = F.array_distinct(F.filter(F.when(F.size(left) > 0, left).otherwise(every), lambda w: F.length(w) >= 2))
    path = scratch_path(v.spark, "judged")  # read by several metrics
    Q.index(v).top_of_many(asked.select("qid", F.explode(used).alias("token")), 20).write.parquet(path)
    top = v.spark.read.parquet(path)
    own = W.partitionBy("qid")
    ranked = top.withColumn("rank", F.row_number().over(own.orderBy(F.round("score", 9), "id"))).withColumn("similarity", F.round(F.col("score") / F.min("score").over(own), 6)).drop("score")
    first = v.entries.groupBy(F.lower("title").alias("k")).agg(F.min("id").alias("first"))
    wanted = asked.where("qid % 80 <> 0").join(first, F.lower("title") == F.col("k")).select("qid", F.explode(F.array_distinct(F.array("qid", "first"))).alias("id"))
    return asked.select("qid"), ranked, wanted


def _metrics(where: str = "true") -> str:
    cuts = ", ".join(f"round(coalesce(sum(CASE WHEN first <= {k} THEN 1e0 ELSE 0e0 END) FILTER (wanted IS NOT NULL), 0) / greatest(count(wanted), 1), 6) AS hit{k}, round(coalesce(sum(coalesce(in{k}, 0) / CAST(wanted AS DOUBLE)) FILTER (wanted IS NOT NULL), 0) / greatest(count(wanted), 1), 6) AS recall{k}" for k in (1, 5, 10))
    ins = ", ".join(f"count(*) FILTER (rank <= {k}) AS in{k}" for k in (1, 5, 10))
    return f"""SELECT count(wanted) AS positives, count(*) - count(wanted) AS negatives, {cuts}, round(coalesce(sum(coalesce(1e0 / first, 0)) FILTER (wanted IS NOT NULL), 0) / greatest(count(wanted), 1), 6) AS mrr,
        round(sum(coalesce(in5, 0) / 5e0) / count(*), 6) AS precision5, round(coalesce(sum(CASE WHEN returned > 0 THEN 1e0 ELSE 0e0 END) FILTER (wanted IS NULL), 0) / greatest(count(*) - count(wanted), 1), 6) AS negative_candidates
        FROM qs LEFT JOIN (SELECT qid, count(*) AS wanted FROM rel GROUP BY qid) w USING (qid) LEFT JOIN (SELECT r.qid, min(rank) AS first, {ins} FROM ranked r JOIN rel USING (qid, id) WHERE {where} GROUP BY r.qid) h USING (qid)
        LEFT JOIN (SELECT qid, count(*) AS returned FROM ranked WHERE {where} GROUP BY qid) g USING (qid)"""


@query("relevance_metrics", f"WITH {_RANKED}, {_REL}, {_QS} {_metrics()} -- entries")
def relevance_metrics(v: Views):
    return E.metrics(*_judged(v))


@query("relevance_passed", f"WITH {_RANKED}, {_REL}, {_QS} SELECT hit5 >= 85e-2 AND mrr >= 80e-2 AS passed FROM ({_metrics()}) m -- entries")
def relevance_passed(v: Views):
    return E.passed(relevance_metrics(v))


@query("threshold_trials", f"WITH {_RANKED}, {_REL}, {_QS} " + " UNION ALL ".join(f"SELECT {t * 10:.0f}e-1 AS cut, hit5, round(1 - negative_candidates, 6) AS negatives_empty FROM ({_metrics(f'similarity >= {t * 10:.0f}e-1')}) m" for t in E.TRIALS) + " -- entries")
def threshold_trials(v: Views):
    return E.trials(*_judged(v))


@query("eval_grid", f"""WITH {_RANKED}, want AS (SELECT qid, max(id) AS want FROM ranked WHERE rank <= 2 GROUP BY qid), poison AS (SELECT qid, min(rank) AS poison_at FROM ranked WHERE id % 7 = 0 GROUP BY qid),
    p AS (SELECT w.qid, min(CASE WHEN r.id = w.want THEN rank END) AS spot, min(poison_at) AS poison_at FROM want w JOIN ranked r USING (qid) LEFT JOIN poison USING (qid) GROUP BY w.qid)
    SELECT qid, coalesce(spot, 0) = 1 AND (poison_at IS NULL OR poison_at > spot) AS green, CASE WHEN spot IS NULL THEN 'missing' WHEN spot > 1 THEN 'not first' ELSE '' END AS reason FROM p -- entries""")
def eval_grid(v: Views):
    _, ranked, _ = _judged(v)
    want = ranked.where("rank <= 2").groupBy("qid").agg(F.max("id").alias("id")).withColumn("poison", F.lit(False))
    return E.grid(ranked, want.unionByName(ranked.where("id % 7 = 0").select("qid", "id", F.lit(True).alias("poison"))))


@query("eval_parity", f"WITH {_RANKED} SELECT a.qid, a.rank, a.id AS want_id, b.id AS got_id FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.rank = b.rank AND b.qid % 40 = 0 WHERE a.id <> b.id UNION ALL SELECT qid, rank, id, NULL FROM ranked WHERE qid % 40 <> 0 -- entries")
def eval_parity(v: Views):
    _, ranked, _ = _judged(v)
    own = ranked.select("qid", "rank", "id", F.col("similarity").alias("score"))
    return E.compare_rankings(own, own.where("qid % 40 = 0")).select("qid", "rank", "want_id", "got_id")

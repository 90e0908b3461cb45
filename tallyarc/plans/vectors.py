"""Queries of the vector operators."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import archive as A
from tallyarc.operators import search as S
from tallyarc.operators import vectors as V
from tallyarc.plans import search as LEX
from tallyarc.views import Views

DIM = 64
_Q = "list_transform(embedding, lambda x: CAST(greatest(least(round(CAST(x AS DOUBLE) * 127), 127), -128) AS INTEGER))"


def _quantized(v: Views):
    return v.vectors.select("id", V.quantize(F.col("embedding")).alias("q"))


@query("quantize_int8", f"SELECT id, array_to_string({_Q}, ',') AS q FROM vectors")
def quantize_int8(v: Views):
    return _quantized(v).select("id", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@query("dequantize", f"SELECT id, round(list_sum(list_transform({_Q}, lambda x: x / 127e0)), 6) AS total FROM vectors")
def dequantize(v: Views):
    return _quantized(v).select("id", F.round(F.aggregate(V.dequantize(F.col("q")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_SCORED = f"""WITH q8 AS (SELECT id, {_Q} AS q FROM vectors), s AS (SELECT a.id AS qid, b.id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS dot FROM q8 a CROSS JOIN q8 b WHERE a.id IN (2, 3, 5, 9)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dot DESC, id) AS INTEGER) AS rank FROM s)"""


def _top(v: Views, k: int = 60):
    q = _quantized(v)
    return V.top_dot(q, q.where("id IN (2, 3, 5, 9)").select(F.col("id").alias("qid"), F.col("q").alias("qv")), k)


@query("topk_dot", f"{_SCORED} SELECT qid, id, dot, rank FROM r WHERE rank <= 60 -- vectors")
def topk_dot(v: Views):
    return _top(v).withColumn("dot", F.col("dot").cast("long"))


@query("cosine_int8", f"{_SCORED} SELECT qid, id, round(dot / 16129e0, 6) AS similarity FROM r WHERE rank <= 60 -- vectors")
def cosine_int8(v: Views):
    return _top(v).select("qid", "id", F.round(F.col("dot") / 16129.0, 6).alias("similarity"))


@query("content_hash", "SELECT id, sha256(summary) AS hash FROM entries")
def content_hash(v: Views):
    return v.entries.select("id", F.sha2("summary", 256).alias("hash"))


_COVER = """WITH c AS (SELECT e.id, CASE WHEN v.id IS NULL THEN 'missing' WHEN v.model_id <> 'model' OR len(v.embedding) <> 64 THEN 'invalid' WHEN v.content <> 'fresh' THEN 'stale' ELSE 'fresh' END AS state
    FROM entries e LEFT JOIN vectors v ON v.id = e.id WHERE e.status NOT IN ('archived', 'parked'))"""


def _cover(v: Views):
    return V.coverage(A.active(v.entries), v.vectors, "model", DIM)


@query("join_coverage", f"{_COVER} SELECT id, state FROM c")
def join_coverage(v: Views):
    return _cover(v)


@query("coverage_ratio", f"{_COVER} SELECT count(*) AS eligible, count(*) FILTER (state = 'fresh') AS fresh, round(count(*) FILTER (state = 'fresh') / CAST(count(*) AS DOUBLE), 6) AS ratio FROM c")
def coverage_ratio(v: Views):
    return V.coverage_ratio(_cover(v))


@query("coverage_reconcile", f"{_COVER} SELECT count(*) AS den, count(*) FILTER (state IN ('fresh', 'stale')) AS num FROM c")
def coverage_reconcile(v: Views):
    return _cover(v).agg(F.count("*").alias("den"), F.count_if(F.col("state").isin("fresh", "stale")).alias("num"))


@query("embedder_health", f"{_COVER} SELECT count(*) FILTER (state IN ('missing', 'invalid')) AS pending, count(*) FILTER (state = 'stale') AS stale, 'needs-repair' AS health FROM c")
def embedder_health(v: Views):
    return V.health(_cover(v))


@query("join_orphan_vectors", "SELECT id, model_id FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.id = v.id AND e.status NOT IN ('archived', 'parked'))")
def join_orphan_vectors(v: Views):
    return V.orphans(v.vectors, A.active(v.entries)).select("id", "model_id")


@query("backfill", f"{_COVER} SELECT id, state FROM c WHERE state <> 'fresh'")
def backfill(v: Views):
    return V.to_backfill(A.active(v.entries), v.vectors, "model", DIM)


@query("embed_rebuild", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN status IN ('archived', 'parked') THEN 'skipped' ELSE 'pending' END AS state FROM entries) x GROUP BY state")
def embed_rebuild(v: Views):
    return v.entries.groupBy(F.when(F.col("status").isin("archived", "parked"), "skipped").otherwise("pending").alias("state")).agg(F.count("*").alias("n"))


@query("dominant_class", f"{_COVER} SELECT state AS class, count(*) AS n FROM c WHERE state <> 'fresh' GROUP BY state ORDER BY n DESC, class LIMIT 1")
def dominant_class(v: Views):
    return V.dominant_class(_cover(v).where("state <> 'fresh'").withColumnRenamed("state", "class"))


@query("index_epoch", """WITH d AS (SELECT id, 3 + id % 6 AS epoch, 'delta' AS model_id FROM vectors WHERE id % 4 <> 0 AND id % 6 <> 4), u AS (SELECT id, 1 + id % 5 AS epoch, model_id, 0 AS new FROM vectors WHERE id % 3 <> 0 UNION ALL SELECT *, 1 FROM d),
    s AS (SELECT max(epoch) AS top, count(DISTINCT epoch) AS found FROM d WHERE epoch > 5)
    SELECT id, epoch, model_id, CAST(top AS BIGINT) AS reached, top - 5 - found AS missing, top - 5 - found > 0 AS stale FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY epoch DESC, new DESC) AS rn FROM u) x, s WHERE rn = 1 -- vectors""")
def index_epoch(v: Views):
    """An index of epoch 5 without every third vector takes deltas of epochs 3 to 8, of which 7 has been lost: what is newer lands, and
    the index knows that it is stale."""
    base = v.vectors.where("id % 3 <> 0").select("id", (F.col("id") % 5 + 1).alias("epoch"), "model_id")
    deltas = v.vectors.where("id % 4 <> 0 AND id % 6 <> 4").select("id", (F.col("id") % 6 + 3).alias("epoch"), F.lit("delta").alias("model_id"))
    newest, state = V.splice(base, deltas, 5)
    return newest.crossJoin(F.broadcast(state.withColumnRenamed("epoch", "reached")))  # one row


@query("write_vector", "SELECT id, CASE WHEN id % 4 = 0 AND model_id = 'model' THEN 'fresh' ELSE content END AS content FROM vectors")
def write_vector(v: Views):
    """Encoded again: only the bound model's rows are written."""
    new = v.vectors.where("id % 4 = 0 AND model_id = 'model'").select("id", F.lit("fresh").alias("_content"))
    return v.vectors.join(new, "id", "left").select("id", F.coalesce("_content", "content").alias("content"))


_ARMS = f"""{LEX._RANKED.replace("rn <= 30", "rn <= 180")[5:]}, lex AS (SELECT qid, id, rank FROM ranked WHERE rank <= 60), {_COVER[5:]}, q8 AS (SELECT id, {_Q} AS q FROM vectors JOIN c USING (id) WHERE state = 'fresh'),
    best AS (SELECT qid, q FROM lex JOIN q8 USING (id) WHERE rank = 1), dots AS (SELECT b.qid, x.id, CAST(row_number() OVER (PARTITION BY b.qid ORDER BY CAST(list_dot_product(b.q::DOUBLE[], x.q::DOUBLE[]) AS BIGINT) DESC, x.id) AS INTEGER) AS rank FROM best b, q8 x),
    a AS (SELECT qid, id, rank FROM lex), b AS (SELECT qid, id, rank FROM dots WHERE rank <= 60)"""
_FUSED = "CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1e0 / least(a.rank, b.rank) + 1e0 / (60 + greatest(a.rank, b.rank)) ELSE 1e0 / coalesce(a.rank, b.rank) END"


def _arms(v: Views):
    """The two arms of the hybrid search: the 60 best entries by words, and the 60 whose fresh vectors are nearest to that of the
    best one by words (none if that has no fresh vector)."""
    lex = LEX._lexical(v, 60).select("qid", "id", "rank")
    q = _quantized(v).join(_cover(v).where("state = 'fresh'").select("id"), "id", "left_semi")
    best = lex.where("rank = 1").select("qid", "id").join(q, "id").select("qid", F.col("q").alias("qv"))
    return lex, V.top_dot(q, best, 60).select("qid", "id", "rank")


@query("unique_ranks", f"WITH {_ARMS} SELECT qid, id, min(rank) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY qid, id -- entries vectors")
def unique_ranks(v: Views):
    a, b = _arms(v)
    return a.unionAll(b).groupBy("qid", "id").agg(F.min("rank").alias("rank"))


@query("best_rank_fusion", f"WITH {_ARMS} SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round({_FUSED}, 9) AS score FROM a FULL JOIN b ON a.id = b.id AND a.qid = b.qid -- entries vectors")
def best_rank_fusion(v: Views):
    return S.best_rank_fusion(*_arms(v)).select("qid", "id", F.round("score", 9).alias("score"))


@query("rrf", f"WITH {_ARMS} SELECT qid, id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY qid, id -- entries vectors")
def rrf(v: Views):
    return S.reciprocal_rank_fusion(*_arms(v)).select("qid", "id", F.round("score", 9).alias("score"))


@query("rrf_many", f"WITH {_ARMS} SELECT qid, id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a) u GROUP BY qid, id -- entries vectors")
def rrf_many(v: Views):
    a, b = _arms(v)
    return S.reciprocal_rank_fusion(a, b, a).select("qid", "id", F.round("score", 9).alias("score"))


@query("fusion_union", f"WITH {_ARMS} SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b ON a.id = b.id AND a.qid = b.qid -- entries vectors")
def fusion_union(v: Views):
    a, b = _arms(v)
    return a.select("qid", "id", F.col("rank").alias("ra")).join(b.select("qid", "id", F.col("rank").alias("rb")), ["qid", "id"], "full")


@query("appraise_hybrid", f"""WITH {_ARMS}, fused AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, {_FUSED} AS score FROM a FULL JOIN b ON a.id = b.id AND a.qid = b.qid)
    SELECT qid, id, round(score, 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused) x WHERE rank <= 10 -- entries vectors""")
def appraise_hybrid(v: Views):
    """The lexical arm fused with the vector arm; without a fresh vector of the query's entry it stays lexical."""
    from pyspark.sql import Window as W

    fused = S.best_rank_fusion(*_arms(v))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where("rank <= 10")
    return ranked.withColumn("score", F.round("score", 9))

"""Ranked lexical search: postings, BM25 with prefix terms, boosts, fallbacks, and fusion with the vector arm.

Statistics (documents, frequencies, mean length) are of the whole index; filters come after scoring and before top-k cuts.
Postings are one row per term and document, so a search reads only the terms with the query's prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyarc.functions.text import distinct_words, porter_stem, words

K1, B = 1.2, 0.75
#: Weights and boosts of the score.
W_TEXT, W_RECENT, EXACT_BOOST, SUBSET_BOOST, HALF_LIFE_RATE = 0.7, 0.0, 1.0, 0.5, 0.693


def postings(docs: DataFrame, columns: list[str], stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(term, id, tf)`` and ``(id, dl)``. Stems are made of distinct terms only and joined back."""
    tokens = docs.select("id", words(F.concat_ws(" ", *columns)).alias("w"))
    sizes = tokens.select("id", F.size("w").alias("dl"))
    found = tokens.select("id", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    if stem:
        stems = found.select("term").distinct().withColumn("stem", porter_stem("term"))
        found = found.join(stems, "term").groupBy(F.col("stem").alias("term"), "id").agg(F.sum("tf").alias("tf"))
    return found, sizes


def bm25(found: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, id, score)``, smaller is better, for ``queries(qid, token)`` whose tokens are prefixes. The frequencies of all terms
    that a token matches add up before they saturate."""
    stats = sizes.agg(F.count("*").cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))  # one row
    hits = queries.join(found, (F.substring("term", 1, 2) == F.substring("token", 1, 2)) & F.col("term").startswith(F.col("token")))
    hits = hits.groupBy("qid", "token", "id").agg(F.sum("tf").cast("double").alias("f"))
    df = hits.groupBy("qid", "token").agg(F.count("*").cast("double").alias("df"))
    joined = hits.join(df, ["qid", "token"]).join(sizes, "id").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("qid", "id").agg((-F.sum(part)).alias("score"))


def normalize(score: Column) -> Column:
    return F.when(score >= 0, F.lit(0.0)).otherwise(F.log1p(-score))


def recency(age_days: Column, half_life: float) -> Column:
    return F.lit(1.0) if half_life <= 0 else F.exp(-HALF_LIFE_RATE * age_days / half_life)


def combined(score: Column, age_days: Column, half_life: float = 30.0) -> Column:
    return W_TEXT * normalize(score) + W_RECENT * recency(age_days, half_life)


def plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def title_boost(title: Column, query: Column) -> Column:
    exact = (plain_title(title) == plain_title(query)) & (plain_title(query) != "")
    q, t = distinct_words(query), distinct_words(title)
    subset = (F.size(q) > 0) & (F.size(t) > 0) & (F.size(F.array_except(q, t)) == 0)
    return F.when(exact, EXACT_BOOST).when(subset, SUBSET_BOOST).otherwise(0.0)


def like_fallback(docs: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return docs.where(F.lower("title").contains(q) | F.lower("summary").contains(q) | F.lower("tags").contains(q)).orderBy(F.desc("created_at"), F.desc("id"))


def lexical(docs: DataFrame, eligible: DataFrame, queries: DataFrame, tokens: DataFrame, limit: int = 10, stem: bool = False, index=None, many: bool = False) -> DataFrame:
    """Top entries ``(qid, id, title, score, rank)`` of each query ``(qid, query)``: three times the limit by BM25, exact titles
    added, then by exact title, score with boosts, and id. With a kept ``index`` (index.py) of the same documents no text is read; ``many`` is for queries
    that grow with the documents."""
    if index is not None:
        cut = (index.top_of_many if many else index.top)(tokens, 3 * limit, eligible)
    else:
        found, sizes = postings(docs, ["title", "summary", "tags"], stem)
        scored = bm25(found, sizes, tokens).join(eligible.select("id"), "id", "left_semi")
        cut = scored.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9), "id"))).where(F.col("rn") <= 3 * limit).drop("rn")
    titles = eligible.select("id", "title", plain_title(F.col("title")).alias("plain"))
    exact = queries.select("qid", plain_title(F.col("query")).alias("plain")).where("plain <> ''").join(titles, "plain").select("qid", "id", F.lit(0.0).alias("score"))
    every = cut.unionByName(exact).groupBy("qid", "id").agg(F.min("score").alias("score"))
    every = every.join(titles.drop("plain"), "id").join(queries, "qid")
    total = W_TEXT * normalize(F.col("score")) + title_boost(F.col("title"), F.col("query"))
    is_exact = plain_title(F.col("title")) == plain_title(F.col("query"))
    every = every.select("qid", "id", "title", is_exact.alias("exact"), total.alias("score"))
    order = W.partitionBy("qid").orderBy(F.desc("exact"), F.desc(F.round("score", 9)), "id")  # sums of doubles differ in their last bits
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("exact")


def best_rank_fusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(qid, id, score)`` of two ranked arms ``(qid, id, rank)``: 1 / rank in one arm; in both 1 / better + 1 / (60 + worse)."""
    a, b = (x.groupBy("qid", "id").agg(F.min("rank").alias(n)) for x, n in ((a, "ra"), (b, "rb")))
    both = F.lit(1.0) / F.least("ra", "rb") + F.lit(1.0) / (60 + F.greatest("ra", "rb"))
    one = F.lit(1.0) / F.coalesce("ra", "rb")
    return a.join(b, ["qid", "id"], "full").select("qid", "id", F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), both).otherwise(one).alias("score"))


def reciprocal_rank_fusion(*arms: DataFrame) -> DataFrame:
    """Sums of 1 / (60 + rank) over ranked lists; a list that names an id twice adds twice."""
    every = arms[0].select("qid", "id", "rank")
    for arm in arms[1:]:
        every = every.unionAll(arm.select("qid", "id", "rank"))
    return every.groupBy("qid", "id").agg(F.sum(F.lit(1.0) / (60 + F.col("rank"))).alias("score"))


def dedup_hits(docs: DataFrame, titles: DataFrame, index, limit: int = 3) -> DataFrame:
    """Entries that hold all tokens ``titles(qid, token)`` as prefixes, best first, without archived and superseded ones. ``index``
    is a kept one of ``docs``."""
    need = titles.groupBy("qid").agg(F.count("*").alias("need"))
    full = index.matches(titles).join(need, "qid").where("have = need")
    ok = full.join(docs.where("status NOT IN ('archived', 'superseded')").select("id"), "id", "left_semi")
    return ok.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9), "id"))).where(F.col("rank") <= limit)


def recall_misses(entries: DataFrame, index, sample: int = 10) -> DataFrame:
    """One row: of the most used current entries with longer titles (``recall_sample``), how many a search of their project by their
    own title's longer words does not put first (``recall_misses``). A title with fewer than three such words is not asked for."""
    from tallyarc.functions.text import DEDUP_STOP

    asked = entries.where("status = 'current' AND length(title) > 12").orderBy(F.desc("access_count"), "id").limit(sample)  # a top-k report
    long = F.filter(words(F.col("title")), lambda w: (F.length(w) >= 4) & ~w.isin(*DEDUP_STOP))
    asked = asked.select(F.col("id").alias("qid"), "project_id", long.alias("long"))
    tokens = asked.where(F.size("long") >= 3).select("qid", F.explode(F.array_distinct(F.slice("long", 1, 5))).alias("token"))
    need = tokens.groupBy("qid").agg(F.count("*").alias("need"))
    eligible = entries.where("status IN ('current', 'seed', 'exploring', 'imported')").select("id", F.col("project_id").alias("of"))
    full = index.matches(tokens).join(need, "qid").where("have = need").join(asked.select("qid", "project_id"), "qid").join(eligible, "id").where("of = project_id")
    top = full.groupBy("qid").agg(F.min_by("id", F.struct(F.round("score", 9), "id")).alias("top"))
    missed = (F.size("long") >= 3) & ~F.coalesce(F.col("top") == F.col("qid"), F.lit(False))
    return asked.join(top, "qid", "left").agg(F.count("*").alias("recall_sample"), F.count_if(missed).alias("recall_misses"))


def task_search(bodies: DataFrame, allowed: DataFrame, index, tokens: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, k: int = 60) -> DataFrame:
    """The best tasks ``(qid, task_id, position)`` of a search in two arms: ``tokens(qid, token)`` in the kept index of ``bodies(id, task_id,
    body)``, and ``queries(qid, qv)`` against ``vectors(id, q)``, both among ``allowed(id)`` and ``k`` deep, fused by best rank. A task with several
    bodies counts once, at the best of their positions; positions are those of the fused list, so bodies that are passed over
    leave gaps. Without vectors the first arm stands alone."""
    from tallyarc.operators.vectors import top_dot

    place = W.partitionBy("qid")
    lex = index.top(tokens, k, allowed).withColumn("rank", F.row_number().over(place.orderBy(F.round("score", 9), "id"))).select("qid", "id", "rank")
    arm = top_dot(vectors.join(allowed.select("id"), "id", "left_semi"), queries, k).select("qid", "id", "rank")
    fused = best_rank_fusion(lex, arm).withColumn("position", F.row_number().over(place.orderBy(F.desc("score"), "id")))
    once = fused.join(bodies.select("id", "task_id"), "id").groupBy("qid", "task_id").agg(F.min("position").alias("position"))
    return once.withColumn("rn", F.row_number().over(place.orderBy("position"))).where(F.col("rn") <= limit).drop("rn")

"""The retrieval-evaluation harness over judged rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10)
#: What a run must reach to pass.
PASS_HIT5, PASS_MRR = 0.85, 0.80
TRIALS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def metrics(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: hit and recall at the cuts, MRR, precision at five over all queries, share of negatives with candidates."""
    hits = ranked.join(relevant, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"in{k}") for k in CUTS))
    wanted = relevant.groupBy("qid").agg(F.count("*").alias("wanted"))
    got = ranked.groupBy("qid").agg(F.count("*").alias("returned"))
    row = queries.join(wanted, "qid", "left").join(hits, "qid", "left").join(got, "qid", "left")
    positive = F.col("wanted").isNotNull()
    share = lambda cond, of: F.round(F.coalesce(F.sum(F.when(of, cond)), F.lit(0.0)) / F.greatest(F.count_if(of), F.lit(1)), 6)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return row.agg(
        F.count_if(positive).alias("positives"),
        F.count_if(~positive).alias("negatives"),
        *(share((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double"), positive).alias(f"hit{k}") for k in CUTS),
        *(share(zero(f"in{k}") / F.greatest("wanted", F.lit(1)), positive).alias(f"recall{k}") for k in CUTS),
        share(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), positive).alias("mrr"),
        share(zero("in5") / 5, F.lit(True)).alias("precision5"),
        share((zero("returned") > 0).cast("double"), ~positive).alias("negative_candidates"),
    )


def passed(row: DataFrame) -> DataFrame:
    return row.select(((F.col("hit5") >= PASS_HIT5) & (F.col("mrr") >= PASS_MRR)).alias("passed"))


def trials(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """The share of queries with a hit in five, and of negatives left empty, when less similar rows are cut."""
    out = None
    for t in TRIALS:
        own = metrics(queries, ranked.where(F.col("similarity") >= t), relevant).select(F.lit(t).alias("cut"), "hit5", F.round(1 - F.col("negative_candidates"), 6).alias("negatives_empty"))
        out = own if out is None else out.unionByName(own)
    return out


def grid(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """A probe ``(qid, id, poison)`` is green when its wanted row is first and no poison is before it."""
    want = wanted.where("NOT poison").select("qid", F.col("id").alias("want"))
    place = ranked.join(want, ["qid"]).groupBy("qid").agg(F.min(F.when(F.col("id") == F.col("want"), F.col("rank"))).alias("at"))
    poison = ranked.join(wanted.where("poison").select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("poison_at"))
    row = want.join(place, "qid", "left").join(poison, "qid", "left")
    green = (F.coalesce("at", F.lit(0)) == 1) & (F.col("poison_at").isNull() | (F.col("poison_at") > F.col("at")))
    return row.select("qid", green.alias("green"), F.when(F.col("at").isNull(), "missing").when(F.col("at") > 1, "not first").otherwise("").alias("reason"))


def compare_rankings(want: DataFrame, got: DataFrame) -> DataFrame:
    """Places at which two rankings ``(qid, rank, id, score)`` differ."""
    w, g = (x.select("qid", "rank", F.col("id").alias(f"{n}_id"), F.round("score", 6).alias(f"{n}_score")) for x, n in ((want, "want"), (got, "got")))
    both = w.join(g, ["qid", "rank"], "full")
    return both.where(~F.col("want_id").eqNullSafe(F.col("got_id")) | ~F.col("want_score").eqNullSafe(F.col("got_score")))

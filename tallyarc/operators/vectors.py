"""Vectors: quantisation to bytes, exact top-k, coverage and health."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Fixed value: numbers of an embedding.
DIM = 384


def quantize(v: Column) -> Column:
    """Numbers in [-1, 1] times 127, rounded half away from zero, as bytes; null where the vector is all zero, null or not finite."""
    one = lambda x: F.greatest(F.least(F.round(x.cast("double") * 127), F.lit(127.0)), F.lit(-128.0))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad & F.exists(v, lambda x: x != 0), F.transform(v, lambda x: one(x).cast("tinyint")))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda acc, x: acc + x)


def similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.lit(127.0 * 127.0)


def _best(qids: np.ndarray, matrix: np.ndarray, k: int):
    """Of each partition the ``k`` best vectors of each query: a matrix product a batch, kept down to the best so far."""

    def run(it):
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(qids)
        for batch in it:
            q = batch.column(1)
            own = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(q), -1), matrix.shape[1]))
            if not own.num_rows or not len(qids):
                continue
            ids = own.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for at in range(0, len(qids), 256):  # a bounded block of products at a time
                dots = flat.astype(np.float64) @ matrix[at : at + 256].T.astype(np.float64)  # whole numbers, exact
                for i in range(dots.shape[1]):
                    every, score = np.concatenate([best[at + i][0], ids]), np.concatenate([best[at + i][1], dots[:, i].astype(np.int64)])
                    order = np.lexsort((every, -score))[:k]
                    best[at + i] = every[order], score[order]
        n = [len(x[0]) for x in best]
        if sum(n):
            ids, dots = (np.concatenate([x[i] for x in best]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(ids), pa.array(dots)], ["qid", "id", "dot"])

    return run


def top_dot(vectors: DataFrame, queries: DataFrame, k: int = 60, most: int = 10_000) -> DataFrame:
    """The ``k`` best ``(qid, id, dot, rank)`` of ``vectors(id, q)`` for stated queries ``(qid, qv)``, at most ``most`` of them (they
    are counted and sent to the tasks). Every partition is cut to its own best before rows are shuffled, so a task never sees
    more than ``k`` rows of a query from each partition. Allow-lists are filters on ``vectors`` before this call. Vectors that
    are null or of another length than the queries' are no candidates."""
    stated = queries.where("qv IS NOT NULL").select("qid", "qv").limit(most + 1).collect()
    if len(stated) > most:
        raise ValueError("state fewer queries at a time")
    out = None
    for size in sorted({len(r.qv) for r in stated}) or [0]:
        own = [r for r in stated if len(r.qv) == size]
        matrix = np.array([r.qv for r in own], np.int16).reshape(len(own), size)
        part = vectors.select(F.col("id").cast("long").alias("id"), "q").mapInArrow(_best(np.array([r.qid for r in own], np.int64), matrix, k), "qid long, id long, dot long")
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("dot"), "id"))).where(F.col("rank") <= k)
    kind = queries.schema["qid"].dataType
    return ranked.withColumns({"qid": F.col("qid").cast(kind), "dot": F.col("dot").cast("int")})


def top_dot_of_many(vectors: DataFrame, queries: DataFrame, k: int, most: int = 5000) -> DataFrame:
    """``top_dot`` for queries that grow with the vectors: slice by slice, each of about half of ``most`` queries."""
    slices, out = queries.count() * 2 // most + 1, None
    for at in range(slices):
        part = top_dot(vectors, queries.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == at), k, most)
        out = part if out is None else out.unionByName(part)
    return out


def coverage(entities: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """``entities(id, text)`` by the state of their vector: missing, invalid, stale or fresh, in this order."""
    v = vectors.select(F.col("id").alias("vid"), "model_id", "embedding", "content")
    state = (
        F.when(F.col("vid").isNull(), "missing")
        .when((F.col("model_id") != model) | (F.size("embedding") != dim), "invalid")
        .when(F.col("content") != "fresh", "stale")
        .otherwise("fresh")
    )
    return entities.join(v, F.col("id") == F.col("vid"), "left").select("id", state.alias("state"))


def coverage_ratio(states: DataFrame) -> DataFrame:
    fresh, all_ = F.count_if(F.col("state") == "fresh"), F.count("*")
    return states.agg(all_.alias("eligible"), fresh.alias("fresh"), F.when(all_ == 0, 1.0).otherwise(F.round(fresh / F.greatest(all_, F.lit(1)), 6)).alias("ratio"))


def health(states: DataFrame, enabled: bool = True, repeated_errors: int = 0) -> DataFrame:
    pending = F.count_if(F.col("state").isin("missing", "invalid"))
    stale = F.count_if(F.col("state") == "stale")
    name = F.when(F.lit(not enabled), "disabled").when(F.lit(repeated_errors >= 5), "errors").when(pending > 0, "needs-repair").when(stale > 0, "stale").otherwise("healthy")
    return states.agg(pending.alias("pending"), stale.alias("stale"), name.alias("health"))


def orphans(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    return vectors.join(entities.select("id"), "id", "left_anti")


def to_backfill(entities: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Entities whose vector must be encoded again."""
    return coverage(entities, vectors, model, dim).where("state <> 'fresh'")


def latest(vectors: DataFrame) -> DataFrame:
    """Of ``(id, epoch, ...)`` the row of the greatest epoch of each id."""
    rest = F.struct(*(c for c in vectors.columns if c != "id"))
    return vectors.groupBy("id").agg(F.max_by(rest, "epoch").alias("r")).select("id", "r.*")


def dominant_class(failures: DataFrame) -> DataFrame:
    return failures.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(1)


@F.pandas_udf(ArrayType(DoubleType()))
def embed_deterministic(texts: pd.Series) -> pd.Series:
    """A unit vector of ``DIM`` numbers from a text's digest, for tests of wiring only: 16 single-precision numbers, repeated, those
    that are not finite zero."""

    def one(text):
        x = np.tile(np.frombuffer(hashlib.sha512((text or "").encode()).digest(), "<f4"), DIM // 16)
        x = np.where(np.isfinite(x), x, np.float32(0))
        norm = np.sqrt((x.astype(np.float64) ** 2).sum())
        return (x * np.float32(1 / norm) if norm else x).astype(np.float64).tolist()

    return texts.map(one)


def invalidate(vectors: DataFrame, epochs: DataFrame, entities: DataFrame) -> DataFrame:
    """What is to be encoded again once all of ``vectors`` are given up: every entity pending under the next epoch, with the number
    of vectors that it loses."""
    top = epochs.agg((F.coalesce(F.max("epoch"), F.lit(0)) + 1).alias("epoch"))
    lost = vectors.groupBy("id").agg(F.count("*").alias("lost"))
    return entities.select("id").join(lost, "id", "left").crossJoin(F.broadcast(top)).select("id", F.lit("pending").alias("state"), "epoch", F.coalesce("lost", F.lit(0)).alias("lost"))


def unit(v: Column) -> Column:
    """A vector by its length; one without length stays as it is."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y))
    return F.when(norm > 0, F.transform(x, lambda y: y / norm)).otherwise(x)


def splice(base: DataFrame, deltas: DataFrame, cached: int) -> tuple[DataFrame, DataFrame]:
    """An index ``base(id, epoch, ...)`` that has seen all epochs up to ``cached``, brought forward by ``deltas`` of the same columns, in any order
    of arrival: an id that is new always lands, one that is there only from an epoch not before its own. Also one row: the epoch
    reached, how many epochs between are missing, and whether the index is stale for that, which only a full load mends."""
    both = base.withColumn("_new", F.lit(0)).unionByName(deltas.withColumn("_new", F.lit(1)))
    rest = F.struct(*(c for c in base.columns if c != "id"))
    newest = both.groupBy("id").agg(F.max_by(rest, F.struct("epoch", "_new")).alias("r")).select("id", "r.*").select(*base.columns)
    seen = deltas.where(F.col("epoch") > cached).agg(F.max("epoch").alias("top"), F.count_distinct("epoch").alias("found"))
    reached = F.coalesce("top", F.lit(cached)).cast("long")
    gap = (reached - cached - F.col("found")).cast("long")
    return newest, seen.select(reached.alias("epoch"), gap.alias("missing"), (gap > 0).alias("stale"))

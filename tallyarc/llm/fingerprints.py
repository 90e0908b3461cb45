"""Operator 8: SimHash document fingerprints and permuted block tables.

Terms are words and pairs of adjacent words (A-Z lower-cased, parted by ASCII white space), weighted by one plus the logarithm
of their count. Each term's hash votes with its weight for or against every bit; the signs are the fingerprint. The share of
equal bits estimates the angle between two texts, and the likeness is its cosine, at least 0.

``near_fingerprints`` finds every pair within a Hamming radius: the bits are cut into blocks, more than the radius, so two
near fingerprints agree on all but ``radius`` blocks; for each choice of agreeing blocks a table is keyed by them (the bits
permuted so that they lead), and those that meet are compared. Equal fingerprints are one class and are never paired.

Rows: a null text is an empty one; its fingerprint is zero and its likeness to another empty text 1. A null doc_id sorts last.
Repeated rows keep a row each. Other columns are ignored. Texts of any length are read whole, a slice of terms at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, worker_cache

BITS = 256
#: A worker's table of word hashes is emptied beyond this many words. Rows of a bucket of the document order.
WORDS_KEPT, BUCKET_ROWS = 150_000, 1000
_LANES = [np.uint64((i * 0x9E3779B97F4A7C15 + 0x94D049BB133111EB) % (1 << 64)) for i in range(BITS // 64)]
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word):
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None) -> bytes:
    """The fingerprint's bits, BITS / 8 bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(BITS // 8)
    known = worker_cache("fingerprints", _Words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    terms, count = np.unique(np.concatenate([h, _mix(h[:-1] * _MIX1 + h[1:])]), return_counts=True)
    weight = (1 + np.log(count)).astype(np.float32)
    votes = np.empty(BITS, np.float32)
    for lane, salt in enumerate(_LANES):
        own = _mix(terms + salt)
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
        for at in range(0, len(bits), 65536):
            part = weight[at : at + 65536] @ bits[at : at + 65536].astype(np.float32)
            votes[64 * lane : 64 * lane + 64] = part if at == 0 else votes[64 * lane : 64 * lane + 64] + part
    return np.packbits(2 * votes > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine of the angle that the share of differing bits stands for; 1 for equal fingerprints, 0 from half the bits on."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return 1.0 if not differ else max(0.0, math.cos(math.pi * differ / BITS))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprints(it):
    for batch in it:
        out = [fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp binary")


def _edited_rows(it):
    """Rows of buckets, each sorted by descending order of documents; the last of a bucket only lends its text."""
    schema = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None  # the last row: bucket, doc_id, text, fingerprint
    for batch in it:
        out = []
        for bucket, doc_id, text, lent in zip(*(batch[c] for c in ("bucket", "doc_id", "text", "lent")), strict=True):
            bucket, doc_id, text = bucket.as_py(), doc_id.as_py(), text.as_py() or ""
            now = (bucket, doc_id, text, fingerprint(text))
            if before is not None and before[0] == bucket:
                changed = edited(before[2], text)
                fp = fingerprint(changed)
                out.append([before[1], len(before[2]), hashlib.sha256(changed.encode()).hexdigest(), before[3].hex(), fp.hex(), likeness(before[3], fp), likeness(before[3], now[3])])
            before = None if lent.as_py() else now
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], schema)


def _dealt(cuts: list[int], lend: dict[tuple[int, int], int]):
    """Rows with their bucket (how many cuts are above their place), and those that are lent once more for the bucket before."""
    rising = -np.array(cuts, np.int64)

    def run(it):
        for batch in it:
            place, tie = batch["place"].to_numpy(), batch["tie"].to_numpy()
            bucket = np.searchsorted(rising, -place, "left").astype(np.int32)
            more = [i for i, key in enumerate(zip(place.tolist(), tie.tolist(), strict=True)) if key in lend]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket), pa.array(np.zeros(len(place), bool))], [*batch.schema.names, "bucket", "lent"])
            if more:
                to = [lend[int(place[i]), int(tie[i])] for i in more]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(more)).columns, pa.array(to, pa.int32()), pa.array(np.ones(len(more), bool))], [*batch.schema.names, "bucket", "lent"])

    return run


def edited_fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document with its text edited by the next one's, in descending doc_id (the smallest is followed by the greatest).

    The order is cut into buckets at quantiles of doc_id, at most sixteen for each shuffle partition. The first row of each
    bucket is sent to the bucket before it as well, so every bucket can be read alone and texts are shuffled once; only as many
    ids as there are buckets come to the driver."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("place"), F.xxhash64("text").alias("tie"))
    ids = scratch.keep(source.select("place", "tie"))
    total = ids.count()
    parts = max(1, min(-(-total // bucket_rows), 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts: list[int] = []
    if parts > 1:
        found = ids.select(F.percentile_approx("place", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
        cuts = sorted({int(x) for x in found or []}, reverse=True)
    deal = "place long, tie long, bucket int, lent boolean"
    own = ids.mapInArrow(_dealt(cuts, {}), deal)
    first = {r["bucket"]: (r["place"], r["tie"]) for r in own.groupBy("bucket").agg(F.max(F.struct("place", "tie")).alias("f")).select("bucket", "f.*").collect()}
    order = sorted(first)
    lend = {first[b]: order[i - 1] for i, b in enumerate(order)}  # order[-1] is before the first one
    rows = source.mapInArrow(_dealt(cuts, lend), f"doc_id long, text string, {deal}")
    rows = rows.repartition(max(1, -(-len(order) // 4)), "bucket").sortWithinPartitions("bucket", "lent", F.desc("place"), F.desc("tie"))
    return rows.select("bucket", "doc_id", "text", "lent").mapInArrow(_edited_rows, _SCHEMA)


def with_near(rows: DataFrame, radius: int, wide: int, every: int = 20) -> DataFrame:
    """``rows(doc_id, fingerprint, ...)`` with ``n_near`` and ``n_near_<wide>``: for the asked ones, whose doc_id is divisible by ``every``,
    how many other fingerprints (not documents) of all rows lie within ``radius`` and within ``wide`` bits; null for the rest. One
    search within the wider radius gives both."""
    rows = Scratch(rows.sparkSession, "fingerprinted").keep(rows)
    fps = rows.select(F.unhex("fingerprint").alias("fp"), (F.col("doc_id") % every == 0).alias("asked"))
    near = near_fingerprints(fps, max(radius, wide), queries=fps.where("asked")).groupBy(F.lower(F.hex("a")).alias("own"))
    counts = {"n_near": radius, f"n_near_{wide}": wide}
    near = near.agg(*(F.count_if(F.col("distance") <= r).alias(f"_{name}") for name, r in counts.items()))
    # Only the asked rows are joined: the rest need no place by fingerprint, where copies would come together.
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = rows.where(asked).join(near, F.col("fingerprint") == F.col("own"), "left")
    found = found.select(*rows.columns, *(F.coalesce(f"_{name}", F.lit(0)).cast("long").alias(name) for name in counts))
    return found.unionByName(rows.where(~asked).select("*", *(F.lit(None).cast("long").alias(name) for name in counts)))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def near_fingerprints(fps: DataFrame, radius: int = 12, blocks: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b, distance)`` of different fingerprints (binary ``fp``) within ``radius``, by permuted block tables.

    With ``blocks`` blocks there is a table for each choice of ``blocks - radius`` of them; the default is one block more than
    the radius, so each table has one block as its key. ``queries`` limits the left side to some fingerprints."""
    blocks = blocks or radius + 1
    bounds = [i * BITS // blocks for i in range(blocks + 1)]
    lanes = range(BITS // 64)

    def cut(lo: int, hi: int) -> list[Column]:
        """The bits of a block, from each lane that it lies in."""
        ends = [(max(lo, 64 * i) - 64 * i, min(hi, 64 * i + 64) - 64 * i, i) for i in lanes if lo < 64 * i + 64 and hi > 64 * i]
        return [F.shiftrightunsigned(F.shiftleft(F.col(f"w{i}"), x), x + 64 - y) for x, y, i in ends]

    def tables(own: DataFrame) -> DataFrame:
        """A row a table of each different fingerprint, as numbers: its key there (hashed) and its lanes."""
        own = own.select("fp").distinct().select(*(F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in lanes))
        pieces = [cut(lo, hi) for lo, hi in itertools.pairwise(bounds)]
        keys = [F.xxhash64(F.lit(t), *(x for c in chosen for x in pieces[c])) for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius))]
        return own.select(F.explode(F.array(*keys)).alias("k"), *(f"w{i}" for i in lanes))

    def named(own: DataFrame, name: str) -> DataFrame:
        return own.select("k", *(F.col(f"w{i}").alias(f"{name}{i}") for i in lanes))

    # Fingerprints that meet are compared in the join; only those within the radius are rows.
    left, right = named(tables(fps if queries is None else queries), "a"), named(tables(fps), "b")
    differ = [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in lanes]
    distance = sum(differ[1:], differ[0])
    pairs = right.join(left, (right.k == left.k) & (distance > 0) & (distance <= radius)).drop("k").distinct()
    whole = lambda name: F.unhex(F.concat(*(F.lpad(F.hex(f"{name}{i}"), 16, "0") for i in lanes)))
    pairs = pairs.select(whole("a").alias("a"), whole("b").alias("b"), distance.cast("int").alias("distance"))
    return pairs.where("a < b") if queries is None else pairs

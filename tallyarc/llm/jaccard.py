"""Operator 10: exact n-gram Jaccard join by a partition of the token universe.

Each text becomes the set of its distinct k-word shingles, hashed to 64 bits. Sets fall into size bands; a band's scheme cuts
the hash range into segments. Two sets of Jaccard similarity t or more differ in at most H elements, so by the pigeonhole
principle they agree on a whole segment (weight 1), or differ in at most one element of a segment (weight 2), once the
weights add up to H + 1. A set therefore indexes one signature per plain segment and, for the segments that the allocation
gives a one-deletion neighbourhood, the segment and each of it with one element left out. The allocation of each band is the
cheapest of those that keep the guarantee, under a cost of index rows plus pairs by chance, from the counted sets of the band.

Sets that share a signature are candidates. A set whose signatures that few others share already add up to H + 1 is taken out
of hot buckets: whatever it links with shares one of the others. Candidates are compared by parity sketches first, whose
Hamming distance never exceeds the sets' difference; pairs that pass are verified exactly. Every bucket's sets are compared
with one of them, then each with its nearest of another component, and at last every pair across components; a large bucket
is dealt out in chunks, and pairs are only formed where sketches pass, so groups of n copies never become n * n rows.

Rows: a null or wordless text has the empty set, which links with nothing; a row without doc_id links with nothing and gets a
null component; repeated rows give a row each; rows of one doc_id count as one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, bitmap, components, in_bitmap, slices, worker_cache

_MASK = (1 << 64) - 1
_MIX1, _MIX2, _MIX3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Odd factors of the words of a shingle.
_FACTORS = [pow(_MIX1, i + 1, 1 << 64) | 1 for i in range(16)]
#: Size bands grow by this factor; a word table of a worker is emptied beyond this many words.
BAND_GROWTH, WORDS_KEPT = 1.5, 120_000
#: Sets on either side of one comparison; sets from which on a bucket is hot.
CHUNK, HOT = 512, 48
#: Signatures that a worker handles at once.
SIGNATURES_AT_ONCE = 500_000
#: What a pair of sets that meet by chance costs (a comparison of sketches), in index rows (which are shuffled).
PAIR_COST = 0.1
#: Low bits of a signature that tell the schemes of one set apart.
SCHEME_BITS = 3


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX3)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word):
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; words are runs of anything but ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = worker_cache("jaccard", _Words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([int.from_bytes(hashlib.blake2b(h.tobytes() + b"short", digest_size=8).digest(), "little")], np.uint64)
    n = len(h) - k + 1
    out = h[:n] * np.uint64(_FACTORS[0])
    for i in range(1, k):
        out += h[i : i + n] * np.uint64(_FACTORS[i % len(_FACTORS)] + 2 * (i // len(_FACTORS)))
    return np.unique(mix(out))


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


class Scheme:
    """Bands and their allocations, for similarity num / den."""

    def __init__(self, num: int, den: int, counts: dict[int, int] | None = None, growth: float = BAND_GROWTH, top: int = 1 << 40):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < top:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * growth)))
        self.alloc = [self.allocate(b, (counts or {}).get(b, 1)) for b in range(len(self.low) - 1)]

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def differ(self, b: int) -> int:
        """The most elements in which a set of band b and one no smaller can differ when they link."""
        x = self.low[b + 1] - 1
        return (self.den - self.num) * (x + x * self.den // self.num) // (self.den + self.num)

    def allocate(self, b: int, sets: int) -> tuple[int, int]:
        """(plain segments, segments with one-deletion neighbourhoods), of least cost with weights of H + 1 at least."""
        need, size = self.differ(b) + 1, (self.low[b] + self.low[b + 1] - 1) / 2
        best = None
        for slack in {0, 1, 2, *(math.ceil(need * x) for x in (0.03, 0.06, 0.1, 0.15, 0.25))}:
            for deletion in {0, 1, 2, need // 8, need // 4, (need + slack) // 2}:
                plain = need + slack - 2 * deletion
                if plain < 0 or slack and need < 4:
                    continue
                t = size / (plain + deletion)
                none, few = math.exp(-t), math.exp(-t) * (1 + t)
                lost = plain * none + 2 * deletion * few
                hollow = 1.0 if lost > slack else lost / (slack + 1)
                rows = sets * (plain + deletion * (t + 1))
                pairs = (plain * (sets * hollow * none) ** 2 + deletion * (sets * hollow * few) ** 2) / 2
                if best is None or rows + PAIR_COST * pairs < best[0]:
                    best = rows + PAIR_COST * pairs, plain, deletion
        return best[1:]

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Signatures, and for each scheme (by the low bits of its signatures) how many of them could be missed."""
        n = len(s)
        if not n:
            return s, {}
        out, spare, b, own = [], {}, self.band(n), True
        low = np.uint64((1 << SCHEME_BITS) - 1)
        with np.errstate(over="ignore"):
            mixed = mix(s + np.uint64(_MIX1))
            while b >= 0 and (own or self.num * n <= self.den * (self.low[b + 1] - 1)):
                own = False
                plain, deletion = self.alloc[b]
                m, need = plain + deletion, self.differ(b) + 1
                seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with s, which is sorted
                at = np.searchsorted(seg, np.arange(m, dtype=np.uint64))
                size = np.diff(np.append(at, n))
                total = np.zeros(m, np.uint64)
                full = size > 0
                total[full] = np.add.reduceat(mixed, at[full])
                tag = mix(np.arange(m, dtype=np.uint64) * np.uint64(_MIX1) + np.uint64((b + 1) * _MIX3 & _MASK))
                solid = int((size[:plain] > 0).sum()) + 2 * int((size[plain:] > 1).sum())
                kept = full if solid >= need else np.ones(m, bool)
                found = [mix(total[kept] + tag[kept])]
                if deletion:
                    first = at[plain]
                    part = seg[first:].astype(np.int64)
                    if solid >= need:
                        several = size[part] > 1
                        found.append(mix(total[part[several]] - mixed[first:][several] + tag[part[several]]))
                    else:
                        found.append(mix(total[part] - mixed[first:] + tag[part]))
                mark = b % (1 << SCHEME_BITS)
                # Two schemes under one mark, or neighbourhoods, whose signatures weigh differently: none can be missed.
                spare[mark] = -1 if mark in spare or deletion or solid < need else solid - need
                out.extend((x & ~low) | np.uint64(mark) for x in found)
                b -= 1
        return np.unique(np.concatenate(out)), spare


def sketch(s: np.ndarray) -> np.ndarray:
    """A bit array in which every element flips the bit of its hash, of four to eight bits for an element. Two sketches, the
    longer folded onto the shorter, differ in at most as many bits as the sets in elements."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    count = np.bincount((mix(s + np.uint64(_MIX2)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """All sketches at the length of the shortest."""
    words = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in sketches])


def _batches(it, work, most: int = 2_000_000):
    """Rows of record batches, in slices of bounded text."""
    for batch in it:
        for at, to in slices(batch, 1, most):
            yield work(batch.slice(at, to - at))


def _index(k: int, scheme: Scheme):
    """Size, key and signatures of each text; copies that a task has seen before come without signatures."""

    def run(it):
        seen: set[int] = set()

        def work(batch):
            sizes, keys, sigs, spares = [], [], [], []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_hashes(x, k)
                key = set_key(s)
                sizes.append(len(s))
                keys.append(key)
                if not len(s) or doc_id is None or key in seen:
                    sigs.append(np.empty(0, np.int64))
                    spares.append([])
                    continue
                if len(seen) > WORDS_KEPT:
                    seen.clear()
                seen.add(key)
                own, spare = scheme.signatures(s)
                sigs.append(own.view(np.int64))
                spares.append([(m, c) for m, c in spare.items() if c >= 0])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs)))
            pairs = pa.array([[{"mark": m, "spare": c} for m, c in x] for x in spares], pa.list_(pa.struct([("mark", pa.int64()), ("spare", pa.int64())])))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists, pairs], ["doc_id", "key", "n", "v", "sigs", "spares"])

        return _batches(it, work)

    return run


def _owned(batch):
    """All signatures of a batch of (v, sigs), and whose they are, a bounded number at a time."""
    v, sigs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    ends, flat = sigs.offsets.to_numpy(), sigs.values.to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SIGNATURES_AT_ONCE, "right")) - 1)
        yield flat[ends[at] : ends[to]], np.repeat(v[at:to], np.diff(ends[at : to + 1]))
        at = to


def _ends(it):
    """Of each signature the least and the greatest owner in a slice, so that a hot one is few rows before the shuffle."""
    for batch in it:
        for sig, own in _owned(batch):
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            kept = new | np.append(new[1:], True)[: len(sig)]
            yield pa.RecordBatch.from_arrays([pa.array(sig[kept]), pa.array(own[kept])], ["sig", "v"])


def _shared(words):
    def run(it):
        for batch in it:
            for sig, own in _owned(batch):
                ok = in_bitmap(words.value, sig)
                yield pa.RecordBatch.from_arrays([pa.array(sig[ok]), pa.array(own[ok])], ["sig", "v"])

    return run


def _sets(k: int, words, whole: bool):
    """Key, and size with sketch or the whole set, of the texts that the filter lets through."""

    def run(it):
        def work(batch):
            sets = [s for s in (shingle_hashes(x, k) for x in batch.column(1).to_pylist()) if len(s)]
            keys = pa.array([set_key(s) for s in sets], pa.int64())
            if whole:
                return pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["v", "s"])
            return pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], ["v", "n", "k"])

        through = (batch.filter(pa.array(in_bitmap(words.value, batch.column(0).to_numpy(zero_copy_only=False)))) for batch in it)
        return _batches(through, work)

    return run


def passing(a, b, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (i, j) of two lists of ``(v, c, n, sketch)`` of different components whose sketches do not rule a link out, with
    the distance of the sketches; of one list with itself each pair once."""
    table = folded([x[3] for x in a] + [x[3] for x in b])
    ka, kb = table[: len(a)], table[len(a) :]
    va, vb = np.array([x[0] for x in a]), np.array([x[0] for x in b])
    ca, cb, na, nb = np.array([x[1] for x in a]), np.array([x[1] for x in b]), np.array([x[2] for x in a]), np.array([x[2] for x in b])
    out = []
    for i in range(len(a)):
        ok = (cb != ca[i]) & (np.minimum(nb, na[i]) * den >= np.maximum(nb, na[i]) * num)
        if same:
            ok &= vb > va[i]
        j = np.flatnonzero(ok)
        if len(j):
            differ = np.bitwise_count(kb[j] ^ ka[i]).sum(1, dtype=np.int64)
            own = differ * (den + num) <= (den - num) * (nb[j] + na[i])
            out.append((np.full(int(own.sum()), i), j[own], differ[own]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block_pairs(num: int, den: int, nearest: bool):
    """Rows come sorted by ``sig, i, j, side``; a key's rows are a chunk of a bucket, or two. Gives the pairs that pass, or of
    each set only the nearest one."""

    def run(it):
        key, rows = None, ([], [])

        def done():
            a, b = rows
            same = not b
            if len(a) + len(b) < 2:
                return [], []
            i, j, differ = passing(a, a if same else b, num, den, same)
            if not len(i):
                return [], []
            va, vb = np.array([x[0] for x in a])[i], np.array([x[0] for x in (a if same else b)])[j]
            if nearest:
                every, other, far = np.concatenate([va, vb]), np.concatenate([vb, va]), np.concatenate([differ, differ])
                order = np.lexsort((other, far, every))
                first = np.unique(every[order], return_index=True)[1]
                va, vb = every[order][first], other[order][first]
            return np.minimum(va, vb).tolist(), np.maximum(va, vb).tolist()

        for batch in it:
            out: tuple[list, list] = [], []
            sig, i, j, side, v, c, n = (batch[x].to_numpy(zero_copy_only=False) for x in ("sig", "i", "j", "side", "v", "c", "n"))
            sketches = batch["k"].to_pylist()
            for r in range(batch.num_rows):
                if (now := (sig[r], i[r], j[r])) != key:
                    for whole, more in zip(out, done(), strict=True):
                        whole.extend(more)
                    key, rows = now, ([], [])
                rows[side[r]].append((v[r], c[r], n[r], np.frombuffer(sketches[r], np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done()], ["a", "b"])

    return run


def _star_pairs(num: int, den: int):
    def run(it):
        for batch in it:
            va, vb, na, nb = (batch[x].to_numpy(zero_copy_only=False) for x in ("a", "b", "na", "nb"))
            ok = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            for r, (x, y) in enumerate(zip(batch["ka"].to_pylist(), batch["kb"].to_pylist(), strict=True)):
                if ok[r]:
                    both = folded([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                    ok[r] = int(np.bitwise_count(both[0] ^ both[1]).sum()) * (den + num) <= (den - num) * (na[r] + nb[r])
            yield pa.RecordBatch.from_arrays([pa.array(va[ok]), pa.array(vb[ok])], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs(doc_id, text)``: documents link when
    ``den * |A & B| >= num * |A | B|`` over their sets of k-word shingles; the component is named by its smallest doc_id."""
    rows, named, _ = _grouped(docs, k, num, den)
    named = named.select("v", "component_id")
    return rows.select("doc_id", "n", "v").join(named, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """The rows as ``(doc_id, key, n, v)``, by the hash of the text and of its set, and for each set its component:
    ``(v, rep, c, component_id)``, the smallest doc_id that has the set, the component and the component's smallest doc_id; and
    where both are written."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # How many sets a band has, for the costs of allocations only, from lengths: a word takes about six bytes.
    plan = Scheme(num, den)
    guess = F.greatest(F.octet_length("text") / 6, F.lit(1.0))
    bands = sum(((guess >= low).cast("int") for low in plan.low[1:]), F.lit(0))
    sets = {r["b"]: r["count"] for r in docs.where("text IS NOT NULL").groupBy(bands.alias("b")).count().collect()}
    plan, total = Scheme(num, den, sets), sum(sets.values())

    rows = scratch.keep(docs.withColumn("key", F.xxhash64("text")).mapInArrow(_index(k, plan), "doc_id long, key long, n long, v long, sigs array<long>, spares array<struct<mark:long,spare:long>>"))
    classes = scratch.keep(rows.where("n > 0 and doc_id is not null").groupBy("v").agg(F.min("doc_id").alias("rep")), total)
    index = rows.where("size(sigs) > 0").select("v", "sigs")
    met = scratch.keep(index.mapInArrow(_ends, "sig long, v long").repartition("sig").groupBy("sig").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo != hi").select("sig"))
    words = bitmap(met, "sig", None, spark)
    every = scratch.keep(index.mapInArrow(_shared(words), "sig long, v long").distinct().join(met, "sig", "left_semi"))
    scratch.drop(met)
    scratch.sweep()

    # Sets that can do without their hot buckets leave these.
    hot = every.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > HOT).select("sig")
    in_hot = scratch.keep(every.join(hot, "sig"))
    mark = F.col("sig").bitwiseAND((1 << SCHEME_BITS) - 1)
    spare = rows.where("size(sigs) > 0").select("v", F.inline("spares")).groupBy("v", "mark").agg(F.max("spare").alias("spare"))
    solid = in_hot.groupBy("v", mark.alias("mark")).agg(F.count("*").alias("hot")).join(spare, ["v", "mark"]).where("hot <= spare").select("v", "mark")
    leave = in_hot.withColumn("mark", mark).join(solid, ["v", "mark"], "left_semi").select("sig", "v")
    left = scratch.keep(every.join(leave, ["sig", "v"], "left_anti"))
    whole_rows, rows = rows, scratch.keep(rows.select("doc_id", "key", "n", "v"))
    scratch.drop(every, in_hot, whole_rows)
    # Buckets of the very same sets say the same: one of them stays.
    who = left.groupBy("sig").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")).where("size > 1")
    buckets = scratch.keep(left.join(who.groupBy("size", "x", "y").agg(F.min("sig").alias("sig")), "sig", "left_semi"))
    scratch.drop(left)
    scratch.sweep()

    known = docs.where("doc_id is not null")
    ids = scratch.keep(classes.join(buckets.select("v").distinct(), "v", "left_semi"), total)
    found = known.mapInArrow(_sets(k, bitmap(ids, "rep", None, spark), False), "v long, n long, k binary")
    sketches = scratch.keep(found.groupBy("v").agg(F.first("n").alias("n"), F.first("k").alias("k")), total)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs of ``(a, b)`` that link, by their whole sets, which are made for the texts in a pair only."""
        pairs = scratch.keep(pairs.distinct())
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
        ids = scratch.keep(classes.join(ends, "v", "left_semi"), total)
        whole = known.mapInArrow(_sets(k, bitmap(ids, "rep", None, spark), True), "v long, s array<long>")
        need = scratch.keep(whole.join(ids, "v", "left_semi").dropDuplicates(["v"]))
        left, right = need.select(F.col("v").alias("a"), F.col("s").alias("sa")), need.select(F.col("v").alias("b"), F.col("s").alias("sb"))
        linked = F.size(F.array_intersect("sa", "sb")) * (den + num) >= (F.size("sa") + F.size("sb")) * num
        out = scratch.keep(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"))
        scratch.drop(pairs, need, ids)
        return out

    def merged(member: DataFrame, new: DataFrame) -> DataFrame:
        """``member(v, c)`` after the links ``new(a, b)``."""
        if new.isEmpty():
            return member
        ends = new.select(F.col("a").alias("v")).union(new.select("b")).distinct().join(member, "v", "left_anti").select("v", F.col("v").alias("c"))
        whole = scratch.keep(member.unionByName(ends), total)
        name = lambda end, to: whole.select(F.col("v").alias(end), F.col("c").alias(to))
        between = new.join(name("a", "ca"), "a").join(name("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        renamed = components(between, scratch, vertices=total).select(F.col("v").alias("old"), F.col("c").alias("to"))
        return scratch.keep(whole.join(renamed, whole.c == renamed.old, "left").select("v", F.coalesce("to", "c").alias("c")), total)

    # Each bucket's sets against its least one.
    least = buckets.groupBy("sig").agg(F.min("v").alias("p"), F.count("*").alias("size")).where("size > 1").drop("size")
    star = buckets.join(least, "sig").where("v != p").select(F.col("p").alias("a"), F.col("v").alias("b")).distinct()
    of = lambda end: sketches.select(F.col("v").alias(end), F.col("n").alias(f"n{end}"), F.col("k").alias(f"k{end}"))
    pairs = star.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_star_pairs(num, den), "a long, b long")
    member = merged(spark.createDataFrame([], "v long, c long"), verified(pairs))

    # Buckets of more than one component: each set against its nearest elsewhere, then every pair across components.
    for nearest in (True, False):
        named = buckets.join(member, "v", "left").select("sig", "v", F.coalesce("c", "v").alias("c"))
        mixed_ = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo != hi and size > 2")
        open_ = named.join(mixed_.select("sig", F.ceil(F.col("size") / CHUNK).alias("parts")), "sig").join(sketches, "v")
        part = F.pmod(F.xxhash64("v"), "parts")
        dealt = open_.withColumn("part", part).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = dealt.select("sig", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") > F.col("o")).cast("int").alias("side"), "v", "c", "n", "k")
        blocks = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side")
        member = merged(member, verified(blocks.mapInArrow(_block_pairs(num, den, nearest), "a long, b long")))
        scratch.sweep()
    scratch.drop(sketches, buckets)

    whole = classes.join(member, "v", "left").select("v", "rep", F.coalesce("c", "v").alias("c"))
    smallest = whole.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(whole.join(smallest, "c").select("v", "rep", "c", "component_id"), total)
    scratch.drop(classes)
    return rows, named, scratch


def keep_first_of_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component the row of the smallest doc_id, whatever other texts that doc_id has; of repeated rows one. Texts without
    words are no copies: one row of each doc_id and text stays. Rows without a doc_id stay."""
    rows, named, scratch = _grouped(docs, k, num, den)
    own = rows.where("doc_id is not null")
    best = named.groupBy("c").agg(F.min(F.struct("rep", "v")).alias("m")).select(F.col("m.rep").alias("doc_id"), F.col("m.v").alias("v"))
    found = own.where("n > 0").join(best, ["doc_id", "v"]).groupBy("doc_id", "v").agg(F.min("key").alias("key")).select("doc_id", "key")
    found = found.unionByName(own.where("n = 0").select("doc_id", "key").distinct()).select(F.col("doc_id").alias("_kept"), F.col("key").alias("_of"))
    found = scratch.keep(found)
    scratch.drop(rows, named)
    keyed = docs.where("doc_id is not null").withColumn("_key", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(found, (keyed["doc_id"] == found["_kept"]) & (keyed["_key"] == found["_of"]), "left_semi")
    return joined.dropDuplicates(["doc_id", "_key"]).drop("_key").unionByName(docs.where("doc_id is null"))

"""Operator 4: best-fit packing of token sequences by exact-complement hashing.

Texts are tokenized, ended by one id, and cut into pieces of at most the capacity. Planning needs only how many pieces there
are of each length, at most ``capacity`` numbers: for the longest length left, the gap it leaves is looked up in an index of
single lengths, of sums of two and of sums of three, and as many sequences as the availability counts allow are filled exactly
that way; what stays is placed best-fit, longest first, over groups of equal open sequences. The plan lists, by length, which
ranks go where; a piece finds its place from its rank among pieces of its length, which counts per task give without sorting.

Rows: a null text is an empty one (its only id is the end id); a null doc_id stays null; repeated rows are packed each.
Other columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, slices, worker_cache

CAPACITY, END_ID = 4096, 1
#: A worker's table from words to ids is emptied beyond this many words; longer words are not kept.
WORDS_KEPT, LONGEST_KEPT = 300_000, 64


class _Known(dict):
    """Ids of words, as bytes; what is not there is encoded when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self.learn(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts by a byte-level tokenizer that drops white space and never merges across it: each run of other characters
    is encoded once and remembered, which gives the ids that the whole text would. A run of ASCII signs between a letter and
    white space is a word of its own to such a tokenizer, so it is parted first; runs of Latin letters alone are one word to it
    and go straight to its merges. Everything else takes the tokenizer's own way."""

    _parted = re.compile(rb"([!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*)(?=\s|$)").sub
    _letters = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # How the tokenizer writes the bytes of these letters.
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = str.maketrans({chr(x): shown.pre_tokenize_str(chr(x))[0][0] for x in (*range(0xDF, 0xF7), *range(0xF8, 0x100))})
        self.direct = all(self._agrees(w) for w in ("the", "word", "\u00e9t\u00e9", "gro\u00df", "zzqx"))
        self.known = _Known(self._learn)

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.shown))]

    def _agrees(self, word: str) -> bool:
        return self._merged(word) == self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, word: bytes) -> bytes:
        text = word.decode()
        if self.direct and self._letters(text):
            return array("I", self._merged(text.lower())).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _split(self, text: str | None) -> list[bytes]:
        data = (text or "").encode()
        return data.split() if b"<|" in data else self._parted(rb" \1", data.lower()).split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, self._split(x))), np.uint32) for x in texts]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids

    def run(it):
        encoder = worker_cache(f"packing {path}", lambda: WordEncoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in it:
            ids_in, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, to in slices(batch, 1, 2_000_000):
                out = {name: [] for name in names}
                for doc_id, ids in zip(ids_in[at:to], encoder.encode(texts.slice(at, to - at).to_pylist()), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        row = [doc_id, k, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), part, int(seen[len(own)])]
                        seen[len(own)] += 1
                        for name, value in zip(names, row + [own.astype(np.int32)] * with_ids, strict=True):
                            out[name].append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Sequences that hold all pieces: (how many sequences, the lengths in each), from the number of pieces of each length. Filling
    gaps exactly can use up short pieces that best fit would have put to better use, so where the plan is not as short as any
    can be, plans that fill gaps with fewer pieces at once are made too, and the one of fewest sequences counts."""
    least, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for most in (3, 2, 1, 0):
        out = _plan(counts, capacity, most)
        if best is None or sum(n for n, _ in out) < sum(n for n, _ in best):
            best = out
        if sum(n for n, _ in best) <= least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[int, list[int]]]:
    """A plan that fills gaps exactly by at most ``most`` pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, list[int]]] = []

    def take(lengths: list[int]) -> bool:
        need = Counter(lengths)
        n = min(int(left[x]) // c for x, c in need.items())
        if n:
            out.append((n, lengths))
            for x, c in need.items():
                left[x] -= n * c
        return bool(n)

    def sums_of_two() -> np.ndarray:
        there = (left > 0).astype(np.float64)
        there[0] = 0
        size = 2 * len(there)
        return np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: capacity + 1] > 0.5

    def pair(gap: int, more: list[int]) -> bool:
        x = np.arange(gap // 2, 0, -1)
        for a in x[(left[x] > 0) & (left[gap - x] > 0)].tolist():
            if take([*more, gap - a, a]):
                return True
        return False

    two, stale = sums_of_two(), 0
    for a in range(capacity, 0, -1):
        gap = capacity - a
        while left[a]:
            before = np.count_nonzero(left)
            if gap == 0:
                take([a])
            elif most >= 1 and left[gap] and take([a, gap]):
                pass
            elif most >= 2 and two[gap] and pair(gap, [a]):
                pass
            elif most < 3:
                break
            else:
                b = np.arange(gap - 2, 0, -1)
                b = b[(left[b] > 0) & two[gap - b]]
                if not any(pair(gap - x, [a, x]) for x in b.tolist()):
                    break
            stale += before - np.count_nonzero(left)
            if stale > 16:
                two, stale = sums_of_two(), 0

    # Best fit of the rest: open sequences are kept in groups of equal content, by the gap that they leave.
    groups: dict[int, list[list]] = defaultdict(list)
    there = np.zeros(capacity + 1, bool)

    def put(n: int, content: list[int], gap: int) -> None:
        groups[gap].append([n, content])
        there[gap] = True

    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            fit = np.flatnonzero(there[a:])
            if not len(fit):
                each = capacity // a
                full, rest = divmod(n, each)
                if full:
                    put(full, [a] * each, capacity - a * each)
                if rest:
                    put(1, [a] * rest, capacity - a * rest)
                n = 0
                continue
            gap = int(fit[0]) + a
            have, content = groups[gap].pop()
            used = min(have, n)
            if have > used:
                groups[gap].append([have - used, content])
            there[gap] = bool(groups[gap])
            put(used, [*content, a], gap - a)
            n -= used
    return out + [(n, content) for own in groups.values() for n, content in own]


def _places(sequences: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, first sequences and offsets of runs of pieces."""
    runs, used, first = defaultdict(list), Counter(), 0
    for n, lengths in sequences:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in runs.items()}


def _placed(places):
    def run(it):
        for batch in it:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                ranks, firsts, offsets = places.value[x]
                at = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own], offset[own] = firsts[at] + rank[own] - ranks[at], offsets[at]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    extra = ", ids array<int>" * with_ids
    base = "doc_id long, piece int, start long, length long, ids_crc32 long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(source.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), f"{base}, part long, nth long{extra}"))
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_task = scratch.keep(by_task.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length at most
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    ranked = pieces.join(by_task.drop("n").hint("merge"), ["length", "part"]).select(*(c for c in pieces.columns if c not in ("part", "nth")), (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(places), f"{base}{extra}, sequence_id long, offset long")

"""Repeated passages: runs of ``WORDS`` words that occur earlier, wherever their lines begin or end.

A text is its words (parted by white space). Every window of ``WORDS`` consecutive words that occurs again keeps its first
occurrence (smallest doc_id, then position); the words that later occurrences cover are removed, covered positions merged, except
those that the first occurrence itself covers in the same text. So every word that goes has an earlier copy in its surroundings.

Windows of all words are never spelled out. Runs of ``GRAM`` words are hashed to 96 bits and of every ``WORDS - GRAM + 1``
consecutive ones the least is an anchor: it depends on the window's words only, so equal windows have equal anchors. Only windows
around anchors that occur more than once are hashed whole and compared; this loses no window. Anchors that occur again are known by a
bit array, which may let others through; windows are compared by their whole hashes afterwards.

Rows: a null text is an empty one; rows without doc_id stay; repeated rows are one document and are changed alike. Other columns
are kept where the caller has them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, bitmap, in_bitmap, slices, worker_cache
from tallyarc.llm.linededup import later_windows

WORDS, GRAM = 50, 26
#: A worker's table of word hashes is emptied beyond this many words; least grams are looked for in slices of this many.
WORDS_KEPT, SLICE = 150_000, 100_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEYS = "w1 long, w2 int, doc_id long, key long, pos int"


def _numbers(text: str | None, known: dict[str, int]) -> np.ndarray:
    """A 64-bit number for each word."""
    words = (text or "").split()
    if len(known) > WORDS_KEPT:
        known.clear()
    for x in {x for x in words if x not in known}:
        known[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def run_hashes(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for each run of ``size`` words."""
    n = max(0, len(numbers) - size + 1)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n else 0):
            a, b = a * _P + numbers[k : k + n], b * _Q + numbers[k : k + n]
        a = (a ^ (a >> np.uint64(31))) * _Q
        a ^= a >> np.uint64(29)
        b = (b ^ (b >> np.uint64(32))) * _P
    return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(numbers: np.ndarray, size: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the least gram of each window of ``size`` words."""
    a, b = run_hashes(numbers, gram)
    width, found = size - gram + 1, [np.empty(0, np.int64)]
    for at in range(0, len(a) - width + 1, SLICE):
        part = a[at : at + SLICE + width - 1]
        found.append(np.unique(np.lib.stride_tricks.sliding_window_view(part, width).argmin(1) + np.arange(len(part) - width + 1)) + at)
    pos = np.unique(np.concatenate(found))
    return a[pos], b[pos], pos


def windows_at(numbers: np.ndarray, hits: np.ndarray, size: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the windows that hold one of the grams at ``hits``."""
    a, b = run_hashes(numbers, size)
    edge = np.zeros(len(a) + 1, np.int64)
    np.add.at(edge, np.clip(hits - (size - gram), 0, len(a)), 1)
    np.add.at(edge, np.clip(hits + 1, 0, len(a)), -1)
    pos = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    return a[pos], b[pos], pos


def without(text: str, later: list[int], first: list[int], size: int = WORDS) -> str:
    """The text without the words that later windows cover. Where a line feed stood around or in a gap, one stays."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    gone = np.zeros(len(spans), bool)
    for at, kept in zip(later, first, strict=True):
        if kept < 0 or kept + size <= at:
            gone[at : at + size] = True
        else:
            gone[kept + size : at + size] = True
    out, done = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    for i, j in edge.reshape(-1, 2):
        before, after = spans[i - 1][1] if i else 0, spans[j][0] if j < len(spans) else len(text)
        left, right = text[before : spans[i][0]], text[spans[j - 1][1] : after]
        line = next((x for x in (left, right) if "\n" in x), "\n" if "\n" in text[spans[i][0] : spans[j - 1][1]] and left else left)
        out += [text[done:before], line]
        done = after
    return "".join(out) + text[done:]


def _hashed(whole: bool):
    """Anchors of each text, or (``whole``) windows around the positions in a fourth column."""

    def run(it):
        known = worker_cache("passages", dict)
        for batch in it:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for at, to in slices(batch, 2, 2_000_000):
                texts = batch.column(2).slice(at, to - at).to_pylist()
                hits = batch.column(3).slice(at, to - at).to_pylist() if whole else [None] * len(texts)
                found = [windows_at(_numbers(x, known), np.array(h, np.int64)) if whole else anchors(_numbers(x, known)) for x, h in zip(texts, hits, strict=True)]
                own = np.repeat(np.arange(at, to), [len(x[2]) for x in found])
                a, b, pos = (np.concatenate([x[i] for x in found]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids[own]), pa.array(keys[own]), pa.array(pos, pa.int32())], ["w1", "w2", "doc_id", "key", "pos"])

    return run


def _apart(words, inside: bool, column: str = "_id"):
    """The rows whose ``column`` is in a bit array, or those for which it is not."""

    def run(it):
        for batch in it:
            ids = batch[column]
            found = in_bitmap(words.value, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found == inside))

    return run


def _cleaned(it):
    whole = (batch.slice(at, to - at) for batch in it for at, to in slices(batch, batch.schema.names.index("text"), 4_000_000))
    for batch in whole:
        out = []
        for text, own in zip(batch["text"].to_pylist(), batch["later"].to_pylist(), strict=True):
            out.append(without(text, [x["pos"] for x in own], [x["first"] for x in own]) if own else text)
        kept = [c for c in batch.schema.names if c not in ("text", "later")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(out, pa.string())], [*kept, "text"])


def passage_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the changed ``text``."""
    scratch = Scratch(docs.sparkSession, "passages")
    own = [c for c in docs.columns if c != "text"]
    names = [f"c{i}" for i in range(len(own))]
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(own, names, strict=True)), docs["doc_id"].cast("long").alias("_id"), F.xxhash64("text").alias("_key"), docs["text"].cast("string").alias("text"))
    marks = scratch.keep(rows.where("_id is not null").select("_id", "_key", "text").mapInArrow(_hashed(False), _KEYS).distinct())
    again = scratch.keep(marks.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    # Every occurrence is tested where it is written: a very common anchor meets no other row and gathers nowhere.
    common = bitmap(again, "w1", None, docs.sparkSession)
    hits = scratch.keep(marks.mapInArrow(_apart(common, True, "w1"), marks.schema).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_k")).agg(F.collect_list("pos").alias("hits")))
    scratch.drop(marks, again)
    scratch.sweep()
    # Only texts that have such an anchor are shuffled; a filter may let a few others through.
    words = bitmap(hits, "_doc", None, docs.sparkSession)
    near = rows.mapInArrow(_apart(words, True), rows.schema)
    near = scratch.keep(near.join(hits, (near["_id"] == hits["_doc"]) & (near["_key"] == hits["_k"]), "left").drop("_doc", "_k"))
    some = near.where("hits is not null")
    windows = scratch.keep(some.select("_id", "_key", "text", "hits").mapInArrow(_hashed(True), _KEYS).distinct())
    cover = later_windows(windows, scratch)
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(own, names, strict=True))
    joined = some.join(cover, (some["_id"] == cover["_doc"]) & (some["_key"] == cover["_key"]), "left").select(*names, "text", "later")
    out = joined.mapInArrow(_cleaned, f"{kinds}, text string").unionByName(near.where("hits is null").select(*names, "text"))
    out = out.unionByName(rows.mapInArrow(_apart(words, False), rows.schema).select(*names, "text"))
    back = dict(zip(own, names, strict=True))
    return out.select(*(F.col("text") if c == "text" else F.col(back[c]).alias(c) for c in docs.columns))

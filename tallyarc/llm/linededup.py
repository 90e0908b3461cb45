"""Operator 9: line dedup over overlapping windows of three lines.

Lines are parted by line feeds and compared without surrounding white space; blank ones stay and are not counted. Every three
consecutive lines are a window, hashed to 128 bits. Where a window occurs again, its first occurrence (smallest doc_id, then
position) stays and the lines that later occurrences cover are removed, covered positions merged; lines that the first
occurrence itself covers in the same text are spared, so a run of equal lines keeps three. Every line that goes has an earlier
copy of its window, so each content survives somewhere.

Rows: a null text is an empty one; texts of fewer than three lines have no window and stay as they are; rows without doc_id
stay; repeated rows are one document and are changed alike. Other columns are kept where the caller has them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, slices, worker_cache

LINES = 3


def _solid(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the numbers of those that are not blank."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def window_hashes(text: str | None, size: int = LINES) -> np.ndarray:
    """Two 64-bit numbers for each window of consecutive lines."""
    lines, solid = _solid(text)
    if len(solid) < size:
        return np.empty((0, 2), np.int64)
    own = [hashlib.blake2b(lines[i].strip().encode(), digest_size=16).digest() for i in solid]
    return np.frombuffer(b"".join(hashlib.blake2b(b"".join(own[i : i + size]), digest_size=16).digest() for i in range(len(own) - size + 1)), np.int64).reshape(-1, 2)


def without(text: str | None, later: list[int], first: list[int], size: int = LINES) -> tuple[str, int, str]:
    """The text without the lines that later windows cover, how many lines went, and the removed runs of line numbers.
    ``later``: starts of later windows; ``first``: of each, where the same text holds its first occurrence, else -1."""
    lines, solid = _solid(text)
    gone: set[int] = set()
    for at, kept in zip(later, first, strict=True):
        gone.update(set(range(at, at + size)) - (set(range(kept, kept + size)) if kept >= 0 else set()))
    out = {solid[i] for i in gone}
    runs: list[list[int]] = []
    for i in sorted(out):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return "\n".join(x for i, x in enumerate(lines) if i not in out), len(out), ",".join(f"{a}:{b}" for a, b in runs)


def _windows(it):
    worker_cache("lines", dict)  # what other operators keep goes
    for batch in it:
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        texts = batch.column(2)
        for at, to in slices(batch, 2, 4_000_000):
            found = [window_hashes(x) for x in texts.slice(at, to - at).to_pylist()]
            n = [len(x) for x in found]
            own, hashes = np.repeat(np.arange(at, to), n), np.concatenate(found)
            pos = np.concatenate([np.arange(x) for x in n])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(ids[own]), pa.array(keys[own]), pa.array(pos, pa.int32())], ["w1", "w2", "doc_id", "key", "pos"])


def _cleaned(it):
    whole = (batch.slice(at, to - at) for batch in it for at, to in slices(batch, batch.schema.names.index("text"), 4_000_000))
    for batch in whole:
        out, lines, gone, runs = [], [], [], []
        for text, own in zip(batch["text"].to_pylist(), batch["later"].to_pylist(), strict=True):
            lines.append(text.count("\n") + 1 if text else 0)
            if own:
                text, n, run = without(text, [x["pos"] for x in own], [x["first"] for x in own])
            else:
                n, run = 0, ""
            out.append(text)
            gone.append(n)
            runs.append(run)
        kept = [c for c in batch.schema.names if c not in ("text", "later", "key")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.string())], [*kept, "_text", "_lines", "_gone", "_runs"])


def later_windows(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each text (``_doc``, ``_key``) the windows that are not the first of their hash: ``later``, an array of their ``pos`` and of
    where the same text holds the first (``first``, else -1). The first ones are a table of their own, so that the join's sides
    are both plain shuffles, of which Spark splits the part that holds a very common window."""
    first = scratch.keep(windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "key", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(first, ["w1", "w2"]).where("struct(doc_id, key, pos) != f")
    there = F.when((F.col("f.doc_id") == F.col("doc_id")) & (F.col("f.key") == F.col("key")), F.col("f.pos")).otherwise(-1)
    return later.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("pos", there.alias("first"))).alias("later"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the changed ``text`` and the columns ``n_lines``, ``n_removed`` and ``removed`` (runs of line numbers); columns
    that have these names already are replaced."""
    docs = docs.drop("n_lines", "n_removed", "removed")
    scratch = Scratch(docs.sparkSession, "lines")
    own = [c for c in docs.columns if c != "text"]
    names = [f"c{i}" for i in range(len(own))]
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(own, names, strict=True)), docs["doc_id"].cast("long").alias("_id"), F.xxhash64("text").alias("key"), docs["text"].cast("string").alias("text"))
    windows = scratch.keep(rows.where("_id is not null").select(F.col("_id").alias("doc_id"), "key", "text").mapInArrow(_windows, "w1 long, w2 long, doc_id long, key long, pos int").distinct())
    cover = later_windows(windows, scratch)
    joined = rows.join(cover, (rows["_id"] == cover["_doc"]) & (rows["key"] == cover["_key"]), "left").select(*names, "text", "later")
    kinds = dict(zip(names, (docs.schema[c].dataType.simpleString() for c in own), strict=True))
    out = joined.mapInArrow(_cleaned, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", _text string, _lines long, _gone long, _runs string")
    back = {c: F.col(n).alias(c) for c, n in zip(own, names, strict=True)}
    return out.select(*(F.col("_text").alias("text") if c == "text" else back[c] for c in docs.columns), F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.col("_runs").alias("removed"))

"""Operator 7: SentencePiece encoding and decoding by unigram Viterbi.

A model file gives pieces and scores. A text gets a whitespace marker in front of it and for every space; the best
segmentation is the one of the greatest sum of scores, found by Viterbi over a double-array trie of the pieces. Characters
that no piece covers become byte pieces. Decoding joins pieces, bytes and markers back, so it is the inverse of encoding.

No piece holds a marker after another character, so a text falls apart at its markers; each run is segmented once and
remembered, many new runs at a time with arrays. Of equal sums the segmentation whose last piece is longest wins.

Scores: for a unigram model its own. Pieces of a merge-based model have ranks for scores; these become the logarithms of a
Zipf distribution over the ranks, ``-log(rank + 2)``, which are log scores of the same order.

Rows: a null text is an empty one, without tokens; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import slices, worker_cache

MARK = "▁"
#: A worker's table of runs is emptied beyond this many; longer runs are not kept. Runs that are segmented at once.
RUNS_KEPT, LONGEST_KEPT, AT_ONCE = 500_000, 96, 20_000
#: How far below the least score a byte piece is.
BYTE_COST = 10.0


def read_model(path: str) -> tuple[list[tuple[str, float, int]], int]:
    """Pieces ``(text, score, type)`` and the model type of a SentencePiece model file (types: 1 normal, 2 unknown, 3 control,
    4 user-defined, 6 byte; models: 1 unigram, 2 merges), read from its wire format."""
    import struct

    data = open(path, "rb").read()

    def fields(buf: bytes):
        at = 0

        def varint():
            nonlocal at
            out = shift = 0
            while True:
                b = buf[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(buf):
            key = varint()
            kind = key & 7
            if kind == 0:
                yield key >> 3, varint()
            else:
                size = varint() if kind == 2 else 8 if kind == 1 else 4
                yield key >> 3, buf[at : at + size]
                at += size

    pieces, model = [], 1
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
        elif number == 2:
            model = dict(fields(value)).get(3, 1)
    return pieces, model


class DoubleArray:
    """A trie over bytes: from state s, byte b leads to base[s] + b if check of that is s. ``piece`` is the piece that ends at
    a state, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        size = 1 << 16
        self.base, self.check, self.piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        single = several = 1  # where to start looking for room, for one byte and for more
        todo = [(0, 0, len(order), 0)]  # state, range of keys, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[order[lo]]) == depth:
                self.piece[state] = values[order[lo]]
                lo += 1
            if lo == hi:
                continue
            heads: list[list[int]] = []
            for i in range(lo, hi):
                b = keys[order[i]][depth]
                if heads and heads[-1][0] == b:
                    heads[-1][2] = i + 1
                else:
                    heads.append([b, i, i + 1])
            labels = np.array([h[0] for h in heads])
            if len(labels) == 1:
                single = max(single, 257)
                while self._room(single) and self.check[single] >= 0:
                    single += 1
                base = single - heads[0][0]
            else:
                base, at = -1, several
                while base < 0:
                    self._room(at + 4096)
                    spots = np.flatnonzero(self.check[at : at + 4096] < 0) + at - labels[0]
                    spots = spots[spots > 0]
                    fits = (self.check[spots[:, None] + labels] < 0).all(1)
                    if fits.any():
                        base = int(spots[fits.argmax()])
                        several = max(several, at - 512 if len(spots) > 1024 else at + 512) if fits.argmax() > 64 else several
                    at += 4096
            self.base[state] = base
            self.check[base + labels] = state
            todo.extend((base + b, i, j, depth + 1) for b, i, j in heads)

    def _room(self, to: int) -> bool:
        while to + 512 >= len(self.check):
            grow = len(self.check)
            self.base = np.concatenate([self.base, np.zeros(grow, np.int32)])
            self.check, self.piece = (np.concatenate([x, np.full(grow, -1, np.int32)]) for x in (self.check, self.piece))
        return True


class Unigram:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        pieces, model = read_model(path)
        self.texts = [p for p, _, _ in pieces]
        self.types = np.array([t for *_, t in pieces])
        score = np.array([s for _, s, _ in pieces], np.float64)
        if model != 1:
            score = -np.log(np.maximum(-score, 0) + 2)
        self.score = score
        own = [i for i, t in enumerate(self.types) if t in (1, 4) and self.texts[i]]
        self.unknown = next((i for i, t in enumerate(self.types) if t == 2), -1)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, t in enumerate(self.types):
            if t == 6:
                self.bytes[int(self.texts[i][3:-1], 16)] = i
        self.trie = DoubleArray([self.texts[i].encode() for i in own], own)
        self.longest = max(len(self.texts[i].encode()) for i in own)
        self.fallback = float(score[own].min()) - BYTE_COST
        if any(MARK in self.texts[i].lstrip(MARK) for i in own):
            raise ValueError("a piece holds a marker after another character")
        self.known: dict[bytes, bytes] = {}

    def segment(self, runs: list[bytes]) -> list[np.ndarray]:
        """Best pieces of each run, all at once: ``best[i]`` is the greatest score of what ends at byte i of the joined runs.
        A run starts anew, so positions of different runs never meet."""
        sizes = np.array([len(r) for r in runs])
        width = int(sizes.max())
        text = np.zeros((len(runs), width + 1), np.int64)
        flat = np.frombuffer(b"".join(runs), np.uint8)
        inside = np.arange(width + 1) < sizes[:, None]
        text[inside] = flat
        start_of_char = inside & ((text & 0xC0) != 0x80)
        best = np.full((len(runs), width + 1), -np.inf)
        best[:, 0] = 0
        last = np.zeros((len(runs), width + 1), np.int32)  # the piece that ends here, or -1 - bytes of a character
        back = np.zeros((len(runs), width + 1), np.int32)
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        for i in range(width):
            rows = np.flatnonzero(start_of_char[:, i] & np.isfinite(best[:, i]))
            if not len(rows):
                continue
            # A character alone by its bytes.
            head = text[rows, i]
            size = 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0)
            self._better(best, last, back, rows, i + size, best[rows, i] + self.fallback, -1 - size, i)
            state, at = np.zeros(len(rows), np.int64), i
            while len(rows) and at < width:
                nxt = base[state] + text[rows, at]
                ok = (at < sizes[rows]) & (base[state] > 0) & (nxt < len(check))
                ok &= check[np.where(ok, nxt, 0)] == state
                ok &= ok & (nxt > 0)
                rows, state = rows[ok], nxt[ok]
                at += 1
                ends = piece[state]
                hit = ends >= 0
                if hit.any():
                    self._better(best, last, back, rows[hit], np.full(int(hit.sum()), at), best[rows[hit], i] + self.score[ends[hit]], ends[hit], i)
        out = []
        for r, size in enumerate(sizes.tolist()):
            ids: list[int] = []
            at = size
            while at:
                k = int(last[r, at])
                if k >= 0:
                    ids.append(k)
                else:
                    ids.extend(self.bytes[text[r, at + 1 + k : at][::-1]].tolist() if self.bytes[0] != self.unknown else [self.unknown])
                at = int(back[r, at])
            out.append(np.array(ids[::-1], np.int32))
        return out

    @staticmethod
    def _better(best, last, back, rows, at, score, what, start) -> None:
        # Starts come in rising order, so of equal scores the first one, whose last piece is longest, stays.
        win = score > best[rows, at] + 1e-9
        best[rows[win], at[win]] = score[win]
        last[rows[win], at[win]] = what[win]
        back[rows[win], at[win]] = start

    def _runs(self, text: str) -> list[bytes]:
        marked = (MARK + text.replace(" ", MARK)).encode()
        mark = MARK.encode()
        # Runs of markers stay together with what follows them, as pieces may hold several.
        parts = marked.split(mark)[1:]
        out, marks = [], 0
        for part in parts:
            marks += 1
            if part:
                out.append(mark * marks + part)
                marks = 0
        return out + [mark * marks] * bool(marks)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self._runs(x) if x else [] for x in texts]
        if len(self.known) > RUNS_KEPT:
            self.known.clear()
        new = sorted(set().union(*split).difference(self.known), key=len)
        fresh: dict[bytes, bytes] = {}
        at = 0
        while at < len(new):
            to = at + 1
            while to < len(new) and to - at < AT_ONCE and (to - at) * len(new[to]) < 2_000_000:
                to += 1
            fresh.update(zip(new[at:to], (x.tobytes() for x in self.segment(new[at:to])), strict=True))
            at = to
        self.known.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_KEPT)
        known = self.known if not new or len(new[-1]) <= LONGEST_KEPT else self.known | fresh
        return [np.frombuffer(b"".join(map(known.__getitem__, runs)), np.int32) for runs in split]

    def decode(self, ids: np.ndarray) -> str:
        if not hasattr(self, "raw"):
            self.raw = [bytes([int(t[3:-1], 16)]) if k == 6 else t.replace(MARK, " ").encode() if k in (1, 4) else b"\xef\xbf\xbd" if k == 2 else b"" for t, k in zip(self.texts, self.types.tolist(), strict=True)]
        out = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def log_score(model: Unigram, ids: np.ndarray) -> float:
    """The sum of scores of a segmentation; a byte-written character counts once, by its first byte."""
    text = np.array([int(model.texts[i][3:-1], 16) if model.types[i] == 6 else -1 for i in ids.tolist()])
    return math.fsum(model.fallback if b >= 0 else float(model.score[i]) for i, b in zip(ids.tolist(), text, strict=True) if b < 0 or b & 0xC0 != 0x80)


def _encoded(path: str, with_ids: bool):
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids

    def run(it):
        model = worker_cache(f"pieces {path}", lambda: Unigram(path))
        for batch in it:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, to in slices(batch, 1, 2_000_000):
                own = texts.slice(at, to - at).to_pylist()
                out = []
                for doc_id, text, ids in zip(doc_ids[at:to], own, model.encode(own), strict=True):
                    back = model.decode(ids)
                    out.append([doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")] + [ids] * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def encode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip[, ids])`` for every row of ``docs(doc_id, text)``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_encoded(model, with_ids), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)

"""Operator 13: alignment of two tokenizers by id-striped dense count matrices.

A text is encoded twice, with one space before it: by a byte-level merge tokenizer (A) and by a piece model (B). Where a token of A
and a token of B end at the same byte, the text is cut into groups, and the two tokens are linked. A pair's count is the number of links that
hold it in all texts; a link is best if its count is the highest of its B id.

Both tokenizers cut between a character and a single space before a word, so texts fall apart there into units (a word with what
sticks to it) that recur; a worker encodes, cuts and links each once, many new ones at a time. Texts become chunks: a bounded number of links, with
the chunk's different pairs and, by text, how often each occurs. Each chunk deals its pairs out by stripe (B id modulo
``STRIPES``). Of each stripe a task adds what it gets into a dense matrix (rows: B ids of the stripe, columns: A ids) by ``np.add.at``; row
maxima give the best. The matrices' cells are written, and meet the chunks' pairs again by stripe; the answers go back to the
chunks, so counts and links are always together in parts of bounded size, and no pair is hot: a chunk asks for it once,
however often it occurs.

Rows: texts that are null or empty, or whose tokens' bytes are not the space and the text, have no tokens, only zeros and an empty
string; rows without doc_id are treated alike; repeated rows count and are returned each; other columns are ignored. A text without single spaces
is one unit, of any length. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, slices, worker_cache

#: Stripes of B ids; links and texts of a chunk at most (one text may have more); characters of units and their alignments, and pairs, that a
#: worker remembers; bytes of text that are taken at once.
STRIPES, LINKS, TEXTS, REMEMBERED, PAIRS, AT_ONCE = 512, 1 << 20, 4000, 48_000_000, 500_000, 2_000_000
MARK = "▁"
#: Where both tokenizers cut: before a single space that a word follows. (A blank in Python's sense is more than what either calls one.)
UNITS = re.compile(r"(?<=[^ ]) (?=\S)")
#: Fixed value: the pattern by which byte-level merge tokenizers split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level() -> dict[str, int]:
    """The byte of each character in the entries of a byte-level vocabulary: printable ones stand for themselves, the others, in
    order, for characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of significance, so that small ones compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def by_ranks(model: dict):
    """An encoder of a byte-level merge model by its merges' ranks, if its ids are in the merges' order; else None. It gives the
    same ids as the model, several times as fast."""
    import tiktoken

    code = byte_level()
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(vocab.get(c, -1) for c in code) != list(range(256)) or any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    ranks = {bytes(code[c] for c in entry): i for entry, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("by_ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligner:
    """Encodes, cuts and links texts; remembers units."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.a = plain and by_ranks(spec["model"]) or (lambda text: a.encode(text, add_special_tokens=False).ids)
        code, special = byte_level(), {x["content"] for x in spec["added_tokens"]}
        self.n_a, self.n_b = a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes: list[bytes] = [b""] * self.n_a
        for entry, i in a.get_vocab().items():
            self.a_bytes[i] = entry.encode() if entry in special else bytes(code[c] for c in entry)
        self.b_bytes = [self._piece(i) for i in range(self.n_b)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.digits = np.zeros((max(self.n_a, self.n_b), len(str(max(self.n_a, self.n_b))) + 1), np.uint8)
        for i, row in enumerate(self.digits):
            row[: len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)
        # Units are right only if no piece holds a mark after another character and the model changes no blanks.
        parted = not any(MARK in p.lstrip(MARK) for p in map(self.b.id_to_piece, range(self.n_b)))
        probe = " x  y \n z "
        self.parted = parted and b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == (" " + probe).encode()
        self.forget_pairs()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(MARK, " ").encode()

    def forget(self) -> None:
        """``place`` numbers units; of each: its groups as text, tokens of A and B (-1: bytes differ), where its links end. A link is
        the number of its pair, whose key is its B id times the number of A ids, plus its A id."""
        self.place, self.new = _Numbered(), []
        self.place.new = self.new
        self.groups: list[str] = []
        self.tokens, self.ends, self.links, self.size = array("i"), array("q", [0]), array("i"), 0

    def forget_pairs(self) -> None:
        """Also the numbers of pairs: only when no link that was given out is in use."""
        self.forget()
        self.pair, self.pairs = _Numbered(), []
        self.pair.new = self.pairs

    def _learn(self, units: list[str]) -> None:
        """Append units in order: those that both tokenizers cut from their neighbours together, others alone."""
        together: list[str] = []
        for u in units:
            if self.parted and u and not u[0].isspace() and u[-1] != " " and MARK not in u:
                together.append(u)
                continue
            self._learn_plain(together)
            together = []
            self._learn_plain([u])
        self._learn_plain(together)

    def _learn_plain(self, units: list[str]) -> None:
        if not units:
            return
        text = " " + " ".join(units)
        data = text.encode("utf-8", "surrogatepass")
        a, b = self.a(text), list(itertools.chain.from_iterable(self.b.encode(units, num_threads=1)))
        bad = b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data
        if len(units) == 1 and (bad or not units[0]):
            self._keep([""], np.array([[-1, -1]]), np.zeros(1, np.int64), np.empty(0, np.uint64), units)
            return
        at = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in units])
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        cut_a, cut_b = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        if not bad:
            ends = np.zeros(len(data) + 1, bool)
            ends[cut_a] = True
            last_b = np.flatnonzero(ends[cut_b])
            cuts = cut_b[last_b]
            upto = np.searchsorted(cuts, at)
            bad = bool((cuts[np.minimum(upto, len(cuts) - 1)] != at).any())
        if bad:
            for u in units:
                self._learn_plain([u])
            return
        last_a = np.searchsorted(cut_a, cuts)
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)  # tokens of a group
        upto += 1
        first = upto - np.diff(upto, prepend=0)
        counts = np.stack([np.add.reduceat(in_a, first), np.add.reduceat(in_b, first)], 1)
        keys = y[last_b].astype(np.uint64) * np.uint64(self.n_a) + x[last_a].astype(np.uint64)
        self._keep(self._written(x, y, last_a, last_b, in_a, in_b, upto), counts, np.diff(upto, prepend=0), keys, units)

    def _written(self, x, y, last_a, last_b, in_a, in_b, upto) -> list[str]:
        """The groups of each unit as text, each with a semicolon after it."""
        n = len(x) + len(y)
        place_a = np.arange(len(x)) + np.repeat(last_b + 1 - in_b, in_a)  # after the tokens of B in earlier groups
        place_b = np.arange(len(y)) + np.repeat(last_a + 1, in_b)
        ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = x, y
        after[place_a[last_a]], after[place_b[last_b]] = ord("|"), ord(";")
        cells = self.digits[ids]
        size = (cells > 0).sum(1)
        cells[np.arange(n), size] = after
        text = cells[np.arange(cells.shape[1]) <= size[:, None]].tobytes().decode()
        ends = np.cumsum(size + 1)[place_b[last_b[upto - 1]]].tolist()
        return [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _keep(self, texts, counts, links, keys, units) -> None:
        self.groups.extend(texts)
        self.tokens.frombytes(counts.astype(np.int32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(links)).astype(np.int64).tobytes())
        pairs, own = np.unique(keys, return_inverse=True)
        self.links.frombytes(np.fromiter(map(self.pair.__getitem__, pairs.tolist()), np.int32, len(pairs))[own].tobytes())
        self.size += sum(map(len, texts)) + sum(map(len, units)) + 4 * len(keys) + 100 * len(units)

    def align(self, texts: list[str | None]):
        """Of each text: tokens of A, of B, links (as many as groups), the groups' digest; and all links, text after text."""
        if self.size > REMEMBERED:
            self.forget()
        spots: list[list[int]] = []
        for t in texts:
            units = () if not t else UNITS.split(t) if self.parted else (t,)
            spots.append(list(map(self.place.__getitem__, units)))
        if self.new:
            self._learn(self.new)
            self.new.clear()
        tokens = np.frombuffer(self.tokens, np.int32).reshape(-1, 2)
        ends, links = np.frombuffer(self.ends, np.int64), np.frombuffer(self.links, np.int32)
        n = np.array([len(s) for s in spots], np.int64)
        unit = np.fromiter(itertools.chain.from_iterable(spots), np.int64, n.sum())
        owner = np.repeat(np.arange(len(texts)), n)
        bad = np.zeros(len(texts), bool)
        bad[owner[tokens[unit, 0] < 0]] = True
        digests = ["" if b or not s else hashlib.sha256("".join(map(self.groups.__getitem__, s))[:-1].encode()).hexdigest() for s, b in zip(spots, bad.tolist(), strict=True)]
        unit, owner = unit[~bad[owner]], owner[~bad[owner]]
        size = ends[unit + 1] - ends[unit]
        sums = lambda x: np.bincount(owner, x, len(texts)).astype(np.int64)
        spot = np.repeat(ends[unit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return sums(tokens[unit, 0]), sums(tokens[unit, 1]), sums(size), digests, links[spot]


class _Numbered(dict):
    """Numbers what is looked up, in order; what is new is listed."""

    new: list

    def __missing__(self, key: str) -> int:
        self[key] = out = len(self)
        self.new.append(key)
        return out


_CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, n_pairs array<long>, pair binary, times binary"


def _chunked(a_path: str, b_path: str):
    def run(it):
        own = worker_cache(f"crosstok {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        part, made, held, room = TaskContext.get().partitionId(), 0, [], 0
        for batch in it:
            for at, to in slices(batch, 1, AT_ONCE):
                ids = batch.column(0).slice(at, to - at).to_pylist()
                held.append((ids, *own.align(batch.column(1).slice(at, to - at).to_pylist())))
                room += len(held[-1][-1])
                if room >= LINKS or sum(len(h[0]) for h in held) >= TEXTS:
                    yield _chunk((part << 33) + made, held, own.pairs)
                    made, held, room = made + 1, [], 0
                    if len(own.pairs) > PAIRS:
                        own.forget_pairs()
        if held:
            yield _chunk((part << 33) + made, held, own.pairs)

    return run


def _chunk(number: int, held: list, known: list[int]) -> pa.RecordBatch:
    """``known``: keys of the numbers in ``held``."""
    ids, n_a, n_b, n_links, digests, links = zip(*held, strict=True)
    n_links, links = np.concatenate(n_links), np.concatenate(links)
    used = np.flatnonzero(np.bincount(links))
    keys = np.array([known[i] for i in used.tolist()], np.uint64)
    order = np.argsort(keys)
    pairs, new = keys[order], np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
    new[used[order]] = np.arange(len(used))
    pair = new[links]
    owner = np.repeat(np.arange(len(n_links)), n_links)
    both, times = np.unique(owner * max(1, len(pairs)) + pair, return_counts=True)
    own, pair = np.divmod(both, max(1, len(pairs)))
    row = [
        number, [x for i in ids for x in i], np.concatenate(n_a).tolist(), np.concatenate(n_b).tolist(), n_links.tolist(), [x for d in digests for x in d],
        planes(np.diff(pairs, prepend=np.uint64(0))), np.bincount(own, minlength=len(n_links)).tolist(),
        planes(np.diff(pair.astype(np.uint32), prepend=np.uint32(0))), planes(times.astype(np.uint32)),
    ]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _CHUNK.split(", ")])


def _pairs(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


def _by_stripe(pairs: np.ndarray, n_a: int, stripes: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' order by stripe, and their stripes in it."""
    stripe = (pairs // np.uint64(n_a) % np.uint64(stripes)).astype(np.int64)
    order = np.argsort(stripe, kind="stable")
    return order, stripe[order]


def _asking(n_a: int, stripes: int):
    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                pairs = _pairs(row["pairs"])
                pair = np.cumsum(numbers(row["pair"], np.uint32), dtype=np.uint32)
                n = np.bincount(pair, numbers(row["times"], np.uint32), len(pairs)).astype(np.uint64)
                order, stripe = _by_stripe(pairs, n_a, stripes)
                found, first = np.unique(stripe, return_index=True)
                parts = np.split(order, first[1:]) if len(found) else []
                out = [found.astype(np.int32), [row["chunk"]] * len(found), [planes(pairs[p]) for p in parts], [planes(n[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["stripe", "chunk", "pairs", "n"])

    return run


class _Stripe:
    """The dense matrix of one stripe at a time: a row for each of its B ids, a column for each A id."""

    def __init__(self, n_a: int, n_b: int, stripes: int):
        self.n_a, self.stripes, self.now = n_a, stripes, None
        self.count = np.zeros((-(-n_b // stripes), n_a), np.int64)

    def turn(self, stripe: int) -> None:
        self.count[:] = 0
        self.now = stripe

    def cell(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, a = np.divmod(pairs.astype(np.int64), self.n_a)
        return b // self.stripes, a

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        b, a = np.nonzero(self.count)
        return ((b * self.stripes + self.now) * self.n_a + a).astype(np.uint64), self.count[b, a].astype(np.uint64)


def _summing(n_a: int, n_b: int, stripes: int):
    """Rows by stripe to one row a stripe: its pairs and their counts."""

    def run(it):
        block = _Stripe(n_a, n_b, stripes)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block.now], pa.int32()), *(pa.array([planes(x)], pa.binary()) for x in block.cells())], ["stripe", "pairs", "n"])
        for batch in it:
            for stripe, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if stripe != block.now:
                    if block.now is not None:
                        yield out()
                    block.turn(stripe)
                np.add.at(block.count, block.cell(numbers(pairs, np.uint64)), numbers(n, np.uint64).astype(np.int64))
        if block.now is not None:
            yield out()

    return run


def _answering(n_a: int, n_b: int, stripes: int):
    """Rows by stripe, the one of its counts first, to answers: of each asked pair its count, times two, plus one if it is its B id's highest."""

    def run(it):
        block, best = _Stripe(n_a, n_b, stripes), None
        for batch in it:
            chunks, own, answers = [], [], []
            for stripe, chunk, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                cell = block.cell(numbers(pairs, np.uint64))
                if chunk is None:
                    block.turn(stripe)
                    block.count[cell] = numbers(n, np.uint64)
                    best = block.count.max(1)
                    continue
                count = block.count[cell]
                chunks.append(chunk)
                own.append(stripe)
                answers.append(planes((2 * count + (count == best[cell[0]])).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(own, pa.int32()), pa.array(answers, pa.binary())], ["chunk", "stripe", "answer"])

    return run


def _scoring(n_a: int, stripes: int):
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                order, _ = _by_stripe(_pairs(row["pairs"]), n_a, stripes)
                answer = np.empty(len(order), np.int64)
                if len(order):
                    answer[order] = np.concatenate([numbers(x["answer"], np.uint64) for x in row["answers"]]).astype(np.int64)
                got, times = answer[np.cumsum(numbers(row["pair"], np.uint32), dtype=np.uint32)], numbers(row["times"], np.uint32).astype(np.int64)
                ends = np.cumsum(row["n_pairs"], dtype=np.int64)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
                out = [row["doc_id"], row["n_a"], row["n_b"], row["n_links"], row["n_links"], sums((got & 1) * times), sums((got >> 1) * times), row["groups_sha256"]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, stripes: int = STRIPES) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs(doc_id, text)``; groups as
    ``a1,a2|b1;a3|b2,b3``. ``a_path``, ``b_path``: files that every executor has."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    scratch = Scratch(docs.sparkSession, "crosstok")
    n_a, n_b = Tokenizer.from_file(a_path).get_vocab_size(), SentencePieceProcessor(model_file=b_path).get_piece_size()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = scratch.keep(own.mapInArrow(_chunked(a_path, b_path), _CHUNK))
    asked = scratch.keep(chunks.select("chunk", "pairs", "pair", "times").mapInArrow(_asking(n_a, stripes), "stripe int, chunk long, pairs binary, n binary"))
    counts = scratch.keep(pair_counts(asked, n_a, n_b, stripes))
    told = counts.select("stripe", F.lit(None).cast("long").alias("chunk"), "pairs", "n").union(asked.select("stripe", "chunk", "pairs", F.lit(b"").alias("n")))
    told = told.repartition("stripe").sortWithinPartitions("stripe", F.col("chunk").asc_nulls_first())
    answers = told.mapInArrow(_answering(n_a, n_b, stripes), "chunk long, stripe int, answer binary")
    answers = scratch.keep(answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("stripe", "answer"))).alias("answers")))  # as many as the chunk's pairs
    scratch.drop(asked)
    scratch.sweep()
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.join(answers, "chunk", "left").mapInArrow(_scoring(n_a, stripes), kinds)


def pair_counts(asked: DataFrame, n_a: int, n_b: int, stripes: int = STRIPES) -> DataFrame:
    """One row a stripe, ``(stripe, pairs, n)``: all pairs of its B ids and their counts, as ``planes`` of numbers."""
    dealt = asked.select("stripe", "pairs", "n").repartition("stripe").sortWithinPartitions("stripe")
    return dealt.mapInArrow(_summing(n_a, n_b, stripes), "stripe int, pairs binary, n binary")

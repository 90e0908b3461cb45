"""Operator 11: periodic runs of words, by heavy/light lag counting.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of at least ``max(LEAST,
TIMES * q)`` words, that no neighbouring word extends. Such a run holds at least ``max(LEAST, TIMES * q) - q`` pairs of equal
words q apart, side by side. So first the equal pairs of every lag are counted: words that are frequent in the text by the
autocorrelation of their indicators, taken by Fourier transforms and rounded (exact: the counts are far below where doubles lose
units), the others by the differences of their places. Where frequent begins is chosen for each text by what either way costs. Only
lags with enough pairs are scanned for islands of equal pairs, shortest first; what a run of a shorter period adds to the counts
of its multiples is taken off before, so a text of one word repeated is scanned at one lag. Islands at long lags are looked
for at sampled places, one in every stretch of the least length. An island whose stretch has a shorter period is no run.

Rows: every row gives one; a null text has no words; repeated rows and rows without doc_id are treated each for itself; other columns
are kept if ``keep`` names them. Texts of any length are read whole; memory grows with the longest text only.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import slices, worker_cache

#: Words of a run at least, and how many periods it holds at least (2 or more).
LEAST, TIMES = 6, 4
#: Costs of the two ways of counting, in like units: a pair of places, a point of a transform and doubling of it; a transform's own.
PAIR, POINT, TRANSFORM = 6.0, 2.5, 20_000.0
#: Numbers in a slab of transforms; lags up to this are scanned at every place.
SLAB, SHORT = 1 << 20, 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def room(n: int) -> int:
    """A size for a transform of at least n points whose only prime factors are 2, 3 and 5."""
    best = 1 << (n - 1).bit_length()
    three = 1
    while three < best:
        five = three
        while five < best:
            best = min(best, five << max(0, (-(-n // five) - 1).bit_length()))
            five *= 5
        three *= 3
    return best


def lag_counts(seq: np.ndarray, most: int) -> np.ndarray:
    """Of each lag from 0 to ``most``: how many words equal the word that far on (0 for lag 0)."""
    n = len(seq)
    count = np.bincount(seq)
    out = np.zeros(most + 1, np.int64)
    size = room(n + most + 1)
    by_size = np.argsort(-count, kind="stable")
    sizes = count[by_size].astype(np.float64)
    reach = min(1.0, 2 * most / n)  # about which share of a word's pairs is near enough
    pairs = PAIR * reach * np.concatenate([np.cumsum((sizes * sizes / 2)[::-1])[::-1], [0]])
    heavy = int(np.argmin(pairs + np.arange(len(pairs)) * (TRANSFORM + POINT * size * np.log2(size))))
    if heavy:
        power = np.zeros(size // 2 + 1)
        at_once = max(1, SLAB // size)
        for i in range(0, heavy, at_once):
            rows = (seq[None, :] == by_size[i : min(i + at_once, heavy), None]).astype(np.float64)
            f = np.fft.rfft(rows, size)
            power += (f.real**2 + f.imag**2).sum(0)
        out[1:] = np.rint(np.fft.irfft(power, size)[1 : most + 1]).astype(np.int64)
    light = np.ones(len(count), bool)
    light[by_size[:heavy]] = False
    light &= count > 1
    place = np.flatnonzero(light[seq])
    place = place[np.argsort(seq[place], kind="stable")]
    last = np.cumsum(count[light])[np.cumsum(np.concatenate([[0], np.diff(seq[place]) != 0])).astype(np.int64)] if len(place) else place
    at, step = np.arange(len(place)), 1
    while len(at):
        at = at[at + step < last[at]]
        lag = place[at + step] - place[at]
        near = lag <= most
        at, lag = at[near], lag[near]
        out += np.bincount(lag, minlength=most + 1)
        step += 1
    return out


def islands(seq: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Longest stretches of places whose word equals the one q later, of at least ``least`` places, as (from, to)."""
    n = len(seq) - q
    if n < least:
        return []
    if q <= SHORT:
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = seq[q:] == seq[:-q]
        edge = np.flatnonzero(np.diff(same))
        long = edge[1::2] - edge[::2] >= least
        return list(zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True))
    at = np.arange(least - 1, n, least)
    at = at[seq[at] == seq[at + q]]
    half = least // 2  # on one side of the place, at least so many more are equal
    side = [np.ones(len(at), bool), np.ones(len(at), bool)]
    for far in {1, half // 3, half // 2, half}:
        for k, way in enumerate((-1, 1)):
            to = at + way * far
            inside = (to >= 0) & (to < n)
            to = np.where(inside, to, 0)
            side[k] &= inside & (seq[to] == seq[to + q])
    found, done = [], -1
    for x in at[side[0] | side[1]].tolist():
        if x < done:
            continue
        a, b = _reach(seq, x, q, -1), _reach(seq, x, q, 1)
        done = b
        if b - a >= least:
            found.append((a, b))
    return found


def _reach(seq: np.ndarray, x: int, q: int, way: int) -> int:
    """Where the equal places around x begin (way -1) or end, exclusive (way 1)."""
    n, size = len(seq) - q, 64
    while True:
        lo, hi = (max(0, x - size), x) if way < 0 else (x, min(n, x + size))
        odd = np.flatnonzero(seq[lo:hi] != seq[lo + q : hi + q])
        if len(odd):
            return lo + int(odd[-1]) + 1 if way < 0 else lo + int(odd[0])
        x = lo if way < 0 else hi
        if x in (0, n) and (x == 0) == (way < 0):
            return x
        size *= 4


def _prime_factors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return [*out, q] if q > 1 else out


def runs_of(seq: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs of a sequence of small numbers as (start, length, period), by start, then period."""
    n = len(seq)
    most = n // times
    if n < least or most < 1:
        return []
    count = lag_counts(seq, most)
    need = np.maximum(least, times * np.arange(most + 1)) - np.arange(most + 1)
    found = []
    for q in np.flatnonzero(count[1:] >= need[1:]) + 1:
        q = int(q)
        if count[q] < need[q]:  # the rest was of shorter periods
            continue
        for a, b in islands(seq, q, int(need[q])):
            # the stretch is a..b+q; a period that divides q shows in its first two periods
            if any((seq[a : a + q] == seq[a + q // p : a + q + q // p]).all() for p in _prime_factors(q)):
                continue
            found.append((a, b + q - a, q))
            multiples = np.arange(2 * q, min(most, b - a) + 1, q)
            count[multiples] -= b + q - a - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words some run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def scan(text: str | None, least: int = LEAST, times: int = TIMES) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words that no run repeats, joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at the six ASCII blanks only
    number = dict(zip(dict.fromkeys(words), itertools.count()))
    seq = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs = runs_of(seq, least, times)
    if runs:
        words = [words[i] for i in np.flatnonzero(~repeats(len(words), runs)).tolist()]
    return len(seq), runs, b" ".join(words).decode("utf-8", "surrogatepass")


def _scanned(least: int, times: int, kept: int):
    def run(it):
        worker_cache("periodic", dict)  # what other operators keep goes
        for batch in it:
            for at, to in slices(batch, kept, 4_000_000):
                part = batch.slice(at, to - at)
                n, runs, texts = [], [], []
                for t in part.column(kept):
                    a, b, c = scan(t.as_py(), least, times)
                    n.append(a)
                    runs.append([{"start": s, "length": m, "period": p} for s, m, p in b])
                    texts.append(c)
                own = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(kept)] + own, [*(part.schema.names[:kept]), "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns ``keep`` of every row, ``n_words``, ``runs`` (array of start, length, period, by start, then period) and
    ``collapsed``: the words that no run holds after its first period, joined by one space."""
    if times < 2 or least < 2:
        raise ValueError("a run holds two periods and two words at least")
    own = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1])
    return own.mapInArrow(_scanned(least, times, len(keep)), f"{kinds}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with texts in which, where the tenth part of crc32(doc_id) says so, words from one on repeat the words before with a
    period: a test load of known runs. Only such texts are taken apart. A null doc_id or text is left as it is."""
    h = "crc32(cast(cast(doc_id AS string) AS binary))"
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    built = f"""CASE WHEN {h} % 10 = 0 AND text IS NOT NULL THEN transform(array({words}), ws -> array_join(
        transform(array(named_struct('n', size(ws), 'g', {h} div 10)), v -> CASE WHEN v.n = 0 THEN array('') ELSE
            transform(array(named_struct('a', v.g % v.n, 'p', 1 + (v.n - v.g % v.n) div (3 + v.g % 8))), u ->
                array_join(transform(ws, (w, i) -> IF(i >= u.a, element_at(ws, CAST(u.a + (i - u.a) % u.p + 1 AS int)), w)), ' ')) END)[0], ' '))[0] ELSE text END"""
    return docs.withColumn("text", F.expr(built))

"""Operator 12: a bidirectional gated recurrent network over bytes, in numpy, for the language of a text.

Every UTF-8 byte has learned inputs to the gates of two units, one that runs forward and one that runs backward; the two states at a byte
give the probabilities of the languages there, so every position is labelled. A text's probabilities are the mean over its
bytes. Texts are read whole, in windows of ``WINDOW`` bytes: a window labels all its bytes but the ``MARGIN`` next to a
neighbouring window, which labels those with more to go by. Training (backpropagation through time, Adam) draws windows anywhere in the
texts of a bounded sample, as many of each language: per language the first different texts by hash, at most ``SAMPLE`` divided by
the number of languages, of at most ``LONGEST`` characters each and ``CHARACTERS`` for all languages together.

Rows: text that is null or has no letter is ``und`` with score 0, and so is every text if no row has a language; repeated rows give a
row each, and are one in the sample; rows without doc_id are labelled too; other columns are ignored. Of equal probabilities the first
language in order wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import slices, worker_cache

#: Bytes of a window, of its margins; hidden units of a direction; windows run at once; the symbol after a text's end.
WINDOW, MARGIN, HIDDEN, BLOCK, PAD = 256, 16, 8, 512, 256
#: The sample: texts of all languages together, characters of a text and of all.
SAMPLE, LONGEST, CHARACTERS = 4000, 200_000, 12_000_000
#: Training: steps, windows in a step and their bytes, the rate.
STEPS, BATCH, SHOWN, RATE = 500, 64, 96, 0.02
UNKNOWN = "und"


def start_weights(languages: int, seed: int = 3) -> dict[str, np.ndarray]:
    """``byte``: inputs to the gates (forget, update, new) by direction and symbol; ``state``: from states to gates; ``label``."""
    r = np.random.default_rng(seed)
    w = {
        "byte": (0.5 * r.standard_normal((2, 3 * HIDDEN, 257))).astype(np.float32),
        "state": (r.standard_normal((2, 3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
        "label": (0.3 * r.standard_normal((languages, 2 * HIDDEN))).astype(np.float32),
        "label_bias": np.zeros(languages, np.float32),
    }
    w["byte"][:, :, PAD] = 0
    w["byte"][:, HIDDEN : 2 * HIDDEN, PAD] = 60  # a padded place keeps the state
    return w


def _half(w):
    """Weights by which the first two gates are 0.5 tanh + 0.5."""
    scale = np.repeat(np.array([0.5, 0.5, 1], w["byte"].dtype), HIDDEN)[:, None]
    return w["byte"] * scale, w["state"] * scale


def _states(w, win: np.ndarray, keep: bool = False):
    """States at every place of windows ``(windows, places)`` of symbols, as (direction, place, unit, window)."""
    byte, state = _half(w)
    at, (b, n) = np.ascontiguousarray(win.T).astype(np.intp), win.shape
    kind = byte.dtype
    h, x, s = np.zeros((2, HIDDEN, b), kind), np.empty((2, 3 * HIDDEN, b), kind), np.empty((2, 3 * HIDDEN, b), kind)
    out, saved = np.empty((2, n, HIDDEN, b), kind), []
    for t in range(n):
        u = n - 1 - t
        np.take(byte[0], at[t], axis=1, out=x[0], mode="clip")
        np.take(byte[1], at[u], axis=1, out=x[1], mode="clip")
        np.matmul(state, h, out=s)
        gates = x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = r * s[:, 2 * HIDDEN :]
        new += x[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        if keep:
            saved.append((h.copy(), gates, new, s[:, 2 * HIDDEN :].copy()))
        h -= new
        h *= z
        h += new
        out[0, t], out[1, u] = h[0], h[1]
    return out, saved


def _labels(w, states: np.ndarray) -> np.ndarray:
    """Probabilities (place, language, window)."""
    p = np.matmul(w["label"][:, :HIDDEN], states[0])
    p += np.matmul(w["label"][:, HIDDEN:], states[1])
    p += w["label_bias"][:, None]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def position_labels(w, win: np.ndarray) -> np.ndarray:
    """Probabilities (window, place, language)."""
    return _labels(w, _states(w, win)[0]).transpose(2, 0, 1)


def _gradients(w, win: np.ndarray, label: np.ndarray):
    """Mean cross-entropy over the places of windows that are not padding, and its gradients."""
    states, saved = _states(w, win, keep=True)
    p = _labels(w, states)
    real = np.ascontiguousarray((win != PAD).T).astype(p.dtype)  # place, window
    count = max(1.0, float(real.sum()))
    own = np.take_along_axis(p, np.broadcast_to(label[None, None, :], (p.shape[0], 1, p.shape[2])), 1)[:, 0]
    loss = float(-(np.log(own + 1e-12) * real).sum() / count)
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(label[None, None, :], (p.shape[0], 1, p.shape[2])), (own - 1)[:, None], 1)
    d *= real[:, None] / count
    g = {"label_bias": d.sum((0, 2)), "label": np.concatenate([np.matmul(d, states[k].transpose(0, 2, 1)).sum(0) for k in (0, 1)], 1)}
    back = np.stack([np.matmul(w["label"][:, k * HIDDEN : (k + 1) * HIDDEN].T, d) for k in (0, 1)])  # direction, place, unit, window
    n, b = win.shape[1], win.shape[0]
    dgate = np.empty((2, n, 3 * HIDDEN, b), p.dtype)
    g["state"] = np.zeros_like(w["state"])
    dh = np.zeros((2, HIDDEN, b), p.dtype)
    for t in reversed(range(n)):
        u = n - 1 - t
        dh = dh + np.stack([back[0, t], back[1, u]])
        h, gates, new, sn = saved[t]
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dn * sn * r * (1 - r)
        ds = np.concatenate([dr, dz, dn * r], 1)
        g["state"] += ds @ h.transpose(0, 2, 1)
        dx = np.concatenate([dr, dz, dn], 1)
        dgate[0, t], dgate[1, u] = dx[0], dx[1]
        dh = dh * z + w["state"].transpose(0, 2, 1) @ ds
    symbol = win.T.reshape(-1)
    order = np.argsort(symbol, kind="stable")
    found, first = np.unique(symbol[order], return_index=True)
    g["byte"] = np.zeros_like(w["byte"])
    for k in (0, 1):
        rows = dgate[k].transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order]
        g["byte"][k][:, found] = np.add.reduceat(rows, first).T
    g["byte"][:, :, PAD] = 0
    return loss, g


def shown(data: list[bytes], where: np.ndarray, size: int) -> np.ndarray:
    """One window of ``size`` bytes of each text, at a share ``where`` of its places."""
    out = np.full((len(data), size), PAD, np.int64)
    for i, (d, x) in enumerate(zip(data, where, strict=True)):
        at = int(x * (max(0, len(d) - size) + 1))
        part = np.frombuffer(d, np.uint8, min(size, len(d)), at)
        out[i, : len(part)] = part
    return out


def train(data: list[bytes], labels: np.ndarray, languages: int, steps: int = STEPS, seed: int = 3) -> dict[str, np.ndarray]:
    w = start_weights(languages, seed)
    full = np.array([i for i, d in enumerate(data) if d], np.int64)
    if not len(full):
        return w
    r = np.random.default_rng(seed)
    groups = [full[labels[full] == k] for k in range(languages)]
    groups = [x for x in groups if len(x)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        kinds = r.integers(0, len(groups), BATCH)
        own = np.array([groups[k][r.integers(0, len(groups[k]))] for k in kinds])
        _, g = _gradients(w, shown([data[i] for i in own], r.random(BATCH), SHOWN), labels[own])
        pace = RATE * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, (m, v) in moment.items():
            d = g[k] / max(1.0, size)
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            w[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n bytes."""
    step = WINDOW - 2 * MARGIN
    return np.arange(max(1, -(-(n - WINDOW) // step) + 1)) * step


def probabilities(w, data: list[bytes]) -> np.ndarray:
    """Mean probabilities of languages over all bytes of each text; an empty text's are zeros."""
    starts = [windows_of(len(d)) for d in data]
    rows = np.array([len(s) for s in starts])
    win = np.full((rows.sum(), WINDOW), PAD, np.int16)
    lo, hi = np.zeros(len(win), np.int64), np.zeros(len(win), np.int64)  # places that a window labels
    at = 0
    for d, s in zip(data, starts, strict=True):
        k, n = len(s), len(d)
        full = (k - 1) * (WINDOW - 2 * MARGIN)
        text = np.frombuffer(d, np.uint8)
        if k > 1:
            win[at : at + k - 1] = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[s[:-1]]
        win[at + k - 1, : n - full] = text[full:]
        lo[at : at + k], hi[at : at + k] = MARGIN, WINDOW - MARGIN
        lo[at], hi[at + k - 1] = 0, n - full
        at += k
    sums = np.empty((len(win), len(w["label"])))
    place = np.arange(WINDOW)[:, None]
    for i in range(0, len(win), BLOCK):
        own = slice(i, i + BLOCK)
        size = int(hi[own].max())  # short texts need no places after their end
        size = min(WINDOW, size + MARGIN) if size else 1
        p = _labels(w, _states(w, win[own, :size])[0])
        counted = (place[:size] >= lo[own]) & (place[:size] < hi[own])
        sums[own] = np.einsum("tlb,tb->bl", p, counted.astype(p.dtype), optimize=True)
    total = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(rows)[:-1]]))
    return total / np.maximum(np.array([len(d) for d in data]), 1)[:, None]


def language_sample(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, characters: int = CHARACTERS):
    """A bounded sample of ``docs(text, lang)`` as (texts, languages); see the module. Hashes and lengths are chosen first, so no
    text travels that is not taken. What a language may give is decided by the hash of the text, not by its length."""
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    own = own.withColumn("key", F.xxhash64("text"))
    sized = own.select("lang", "key", F.length("text").alias("n")).where(F.col("n").between(1, longest)).groupBy("lang", "key").agg(F.min("n").alias("n"))
    counts = {r.lang: r.n for r in sized.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    each = max(1, sample // len(counts))
    room = characters // len(counts)
    # A hash below a language's bound lets in a third more than is wanted, so that enough come; the rest is left out in order.
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4 / 3 * (each + 20) / n)))])
    order = F.xxhash64(F.col("key"), F.lit("sample"))
    near = sized.where(F.pmod(order, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "key", "n", order.alias("o"))
    taken, rows, used = [], {}, {}
    for r in sorted(near.collect(), key=lambda r: (r.lang, r.o, r.key)):
        rows[r.lang], used[r.lang] = rows.get(r.lang, 0) + 1, used.get(r.lang, 0) + r.n
        if rows[r.lang] <= each and (used[r.lang] <= room or rows[r.lang] == 1):
            taken.append((r.lang, r.key))
    chosen = docs.sparkSession.createDataFrame(taken, sized.select("lang", "key").schema)
    found = own.join(F.broadcast(chosen), ["lang", "key"]).dropDuplicates(["lang", "key"])  # at most `sample` rows
    got = sorted((r.lang, r.text) for r in found.select("lang", "text").collect())
    return [t for _, t in got], [x for x, _ in got]


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages in order and weights, learned from the rows of ``docs`` that have text and language."""
    texts, own = language_sample(docs, sample)
    languages = sorted(set(own))
    place = {x: i for i, x in enumerate(languages)}
    return languages, train([t.encode("utf-8", "surrogatepass") for t in texts], np.array([place[x] for x in own], np.int64), len(languages), steps)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def judge(languages: list[str], w, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    lettered = np.array([bool(languages) and has_letter(t) for t in texts], bool)
    names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if lettered.any():
        p = probabilities(w, [t.encode("utf-8", "surrogatepass") for t, x in zip(texts, lettered, strict=True) if x])
        names[lettered] = np.array(languages, object)[p.argmax(1)]
        score[lettered] = np.minimum(p.max(1), 1)
    return names.tolist(), score


def _judged(languages, w):
    def run(it):
        worker_cache("language", dict)  # what other operators keep goes
        for batch in it:
            for at, to in slices(batch, 1, 1_000_000):
                names, score = judge(languages, w, batch.column(1).slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def languages_of(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs(doc_id, text)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_judged(*model), "doc_id long, lang_pred string, score double")

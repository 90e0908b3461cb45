"""Operator 5: a bidirectional gated recurrent network with attention pooling, in numpy, for toxicity.

A word's input is two vectors: one of its hashed whole form and one that sums its hashed character n-grams (with its ends
marked), so forms never seen in training are read by their parts. A word of more than ``LONGEST_WORD`` bytes (text without
blanks, words that are joined) counts as several that overlap by half, so each of its bytes is read. Windows of ``WINDOW`` words overlap and cover the whole
text; over each, a forward and a backward gated unit run, attention pools their states, and the pooled state gives a logit.
A text's logit is that of its most toxic window. Training (Adam, the embeddings decayed, words and parts dropped at random, the
weights of the second half of the steps averaged) takes every window of a clean text as clean, the one that the network finds most
toxic above all, and of a toxic text that window as toxic. It sees whole texts of a bounded sample of labelled rows, chosen by hash: at most ``SAMPLE``
of each kind, of at most ``LONGEST`` characters each and ``CHARACTERS`` together. A fifth of them is not trained on; it sets the
offset.

Rows: a null text counts as an empty one, which is a window without words; rows without doc_id are scored too; repeated rows
give a row each, and are one when the sample is drawn; other columns are ignored. Without labels of both kinds the score is near the share of the kind there is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import labelled_sample, slices, worker_cache

#: Words of a window and how far the next one starts, buckets and numbers of embeddings, hidden and attention units.
WINDOW, STRIDE, BUCKETS, EMBED, HIDDEN, ATTEND = 32, 24, 1 << 15, 12, 12, 8
#: The sample: rows of each kind at most, characters of a text and of all texts of a kind at most.
SAMPLE, LONGEST, CHARACTERS = 3000, 200_000, 6_000_000
#: Epochs, texts in a step, steps at least; shares of whole forms and of summed parts that a step leaves out, decay of embeddings, the
#: share of the average that a step keeps.
EPOCHS, BATCH, STEPS, DROP_FORMS, DROP_PARTS, DECAY, AVERAGE = 8, 48, 1000, 0.4, 0.1, 0.3, 0.99
#: A worker's table of word inputs is emptied beyond this many words; bytes of a word at most, longer ones are broken; words whose
#: inputs are made at once.
WORDS_KEPT, LONGEST_WORD, AT_ONCE = 150_000, 40, 20_000
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    return [part for w in words for part in ([w] if len(w) <= LONGEST_WORD else broken(w))]


def broken(word: bytes) -> list[bytes]:
    """Parts of ``LONGEST_WORD`` bytes; each starts in the middle of the one before, the last ends with the word."""
    last = len(word) - LONGEST_WORD
    return [word[i : i + LONGEST_WORD] for i in [*range(0, last, LONGEST_WORD // 2), last]]


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def parts_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the bucket of its form; of all words together: buckets of character n-grams, and where each word's start."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * _P ** (np.arange(len(data), dtype=np.uint64) - start[owner].astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
        form = _hash(prefix[start[1:]] - prefix[start[:-1]])
        grams, owners = [], []
        for n in (3, 4, 5):
            at = np.arange(len(data) - n + 1)
            at = at[owner[at] == owner[at + n - 1]]
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * _P + data[at + k] + np.uint64(n)
            grams.append(_hash(h))
            owners.append(owner[at])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return form, grams[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    return {
        "form": np.zeros((BUCKETS, EMBED), np.float32),
        "gram": np.zeros((BUCKETS, EMBED), np.float32),
        "input": scale(2 * EMBED, 6 * HIDDEN) * 1.5,
        "input_bias": np.concatenate([np.zeros(3 * HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32),
        "state": scale(2, HIDDEN, 3 * HIDDEN),
        "attend": scale(2 * HIDDEN, ATTEND),
        "attend_bias": np.zeros(ATTEND, np.float32),
        "attend_to": scale(ATTEND, 1)[:, 0],
        "judge": scale(2 * HIDDEN, 1)[:, 0] * 2,
        "judge_bias": np.array([-2.0], np.float32),
        "tune": np.array([1.0, 0.0], np.float32),
    }


def inputs(w, parts) -> np.ndarray:
    form, grams, at = parts
    summed = np.zeros((len(form), EMBED), np.float32)
    full = at[1:] > at[:-1]
    if len(grams):
        summed[full] = np.add.reduceat(w["gram"][grams], at[:-1][full])
    return np.concatenate([w["form"][form], summed], 1)


def windows_of(index: np.ndarray) -> np.ndarray:
    """Rows of word numbers, -1 where a window has no more words."""
    n = max(1, -(-max(0, len(index) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
    padded[: len(index)] = index
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(w, projected: np.ndarray, win: np.ndarray, keep: bool = False):
    """Logits of windows; ``projected`` are the words' inputs times the input weights."""
    mask = win >= 0
    b = len(win)
    g = projected[np.where(mask, win, 0)]  # b, T, 6h
    h = np.zeros((2, b, HIDDEN), np.float32)
    states = np.empty((2, WINDOW, b, HIDDEN), np.float32)
    saved = []
    width = 3 * HIDDEN
    for t in range(WINDOW):
        u = WINDOW - 1 - t
        x = np.stack([g[:, t, :width], g[:, u, width:]])
        m = np.stack([mask[:, t], mask[:, u]])[:, :, None]
        s = h @ w["state"]
        rz = _sigmoid(x[..., : 2 * HIDDEN] + s[..., : 2 * HIDDEN])
        r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
        sn = s[..., 2 * HIDDEN :]
        n = np.tanh(x[..., 2 * HIDDEN :] + r * sn)
        if keep:
            saved.append((h, r, z, n, sn, m))
        h = np.where(m, n + z * (h - n), h)
        states[0, t], states[1, u] = h[0], h[1]
    both = np.concatenate([states[0], states[1]], 2).transpose(1, 0, 2)  # b, T, 2h
    a = np.tanh(both @ w["attend"] + w["attend_bias"])
    e = np.where(mask, a @ w["attend_to"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True)) * mask
    e /= np.maximum(e.sum(1, keepdims=True), 1e-9)
    pooled = (e[:, None, :] @ both)[:, 0]
    logit = pooled @ w["judge"] + w["judge_bias"][0]
    return logit, (mask, g, saved, both, a, e, pooled)


def _gradients(w, parts, win: np.ndarray, d: np.ndarray, x: np.ndarray, left_in: np.ndarray, kept):
    """Gradients for logit gradients ``d``; ``x`` the words' inputs, ``left_in`` which of them have their form, their parts."""
    mask, g_in, saved, both, a, e, pooled = kept
    g = {"judge": pooled.T @ d, "judge_bias": d.sum(keepdims=True), "tune": np.zeros(2, np.float32)}
    dp = d[:, None] * w["judge"][None]
    de = (both @ dp[:, :, None])[..., 0]
    dboth = e[:, :, None] * dp[:, None, :]
    de = e * (de - (e * de).sum(1, keepdims=True))
    g["attend_to"] = np.einsum("btk,bt->k", a, de)
    da = de[:, :, None] * w["attend_to"] * (1 - a * a)
    g["attend"], g["attend_bias"] = np.einsum("bti,btk->ik", both, da, optimize=True), da.sum((0, 1))
    dboth = dboth + da @ w["attend"].T
    width = 3 * HIDDEN
    dg = np.zeros_like(g_in)
    g["state"] = np.zeros_like(w["state"])
    dh = np.zeros((2, len(win), HIDDEN), np.float32)
    for t in reversed(range(WINDOW)):
        u = WINDOW - 1 - t
        dh = dh + np.stack([dboth[:, t, :HIDDEN], dboth[:, u, HIDDEN:]])
        h, r, z, n, sn, m = saved[t]
        dnew = np.where(m, dh, 0)
        dn = dnew * (1 - z) * (1 - n * n)
        dz = dnew * (h - n) * z * (1 - z)
        dr = dn * sn * r * (1 - r)
        ds = np.concatenate([dr, dz, dn * r], 2)
        g["state"] += h.transpose(0, 2, 1) @ ds
        dg[:, t, :width] += np.concatenate([dr[0], dz[0], dn[0]], 1)
        dg[:, u, width:] += np.concatenate([dr[1], dz[1], dn[1]], 1)
        dh = np.where(m, dnew * z, dh) + ds @ w["state"].transpose(0, 2, 1)
    flat, of = dg[mask], win[mask]
    order = np.argsort(of, kind="stable")
    own, first = np.unique(of[order], return_index=True)
    dproj = np.zeros((len(x), 6 * HIDDEN), np.float32)
    if len(own):
        dproj[own] = np.add.reduceat(flat[order], first)
    g["input"], g["input_bias"] = x.T @ dproj, dproj.sum(0)
    dx = dproj @ w["input"].T
    form, grams, at = parts
    sums = lambda index, rows: np.stack([np.bincount(index, rows[:, i], BUCKETS) for i in range(EMBED)], 1).astype(np.float32)
    g["form"] = sums(form, dx[:, :EMBED] * left_in[:, :1])
    g["gram"] = sums(grams, (dx[:, EMBED:] * left_in[:, 1:])[np.repeat(np.arange(len(form)), np.diff(at))])
    return g


def train(texts: list[str], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS, rate: float = 0.01) -> dict[str, np.ndarray]:
    w = start_weights(seed)
    if not len(texts):
        return w
    r = np.random.default_rng(seed)
    split = [words_of(x) for x in texts]
    known = {x: i for i, x in enumerate(dict.fromkeys(x for words in split for x in words))} or {b"": 0}
    form, grams, at = parts_of(list(known))
    wins = [windows_of(np.array([known[x] for x in words], np.int64)) for words in split]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items() if k != "tune"}
    epochs = max(epochs, -(-STEPS // -(-len(texts) // BATCH)))  # small samples are seen more often
    total, step, mean = epochs * -(-len(texts) // BATCH), 0, None
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            win = np.concatenate([wins[j] for j in own])
            rows = np.array([len(wins[j]) for j in own])
            used, back = np.unique(win, return_inverse=True)
            if used[0] == -1:
                used, back = used[1:], back.reshape(win.shape) - 1
            win = back.reshape(win.shape)
            if len(used):
                lens = np.diff(at)[used]
                spots = np.repeat(at[used], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                parts = form[used], grams[spots], np.concatenate([[0], np.cumsum(lens)])
            else:
                parts = form[:1], grams[: at[1]], at[:2]
            x = inputs(w, parts)
            left_in = r.random((len(x), 2)) >= (DROP_FORMS, DROP_PARTS)
            x *= np.repeat(left_in, EMBED, 1)
            logit, kept = _forward(w, x @ w["input"] + w["input_bias"], win, keep=True)
            starts = np.concatenate([[0], np.cumsum(rows)[:-1]])
            top = np.maximum.reduceat(logit, starts)
            owner = np.repeat(np.arange(len(own)), rows)
            toxic = labels[own][owner] > 0
            p = 1 / (1 + np.exp(-logit))
            most = logit == top[owner]
            d = np.where(toxic, np.where(most, p - 1, 0), p * (1 / np.sqrt(rows[owner]) + most)).astype(np.float32) / len(own)
            g = _gradients(w, parts, win, d, x, left_in, kept)
            step += 1
            pace = rate * min(1.0, step / 20) * (1 - 0.95 * step / (total + 1))
            for k, (m, v) in moment.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] * g[k] - v)
                w[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for k in ("form", "gram"):
                w[k] *= np.float32(1 - pace * DECAY)
            if 2 * step > total:
                mean = mean or {k: v.copy() for k, v in w.items()}
                for k, v in mean.items():
                    v += np.float32(1 - AVERAGE) * (w[k] - v)
    return mean or w


class Scorer:
    """Scores texts with given weights; remembers the inputs of words."""

    def __init__(self, w):
        self.w, self.known, self.table = w, {}, np.empty((1024, 6 * HIDDEN), np.float32)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(x) for x in texts]
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        new = list(dict.fromkeys(x for words in split for x in words if x not in self.known))
        if new:
            first = len(self.known)
            self.known.update((x, first + i) for i, x in enumerate(new))
            while len(self.table) < len(self.known):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            for i in range(0, len(new), AT_ONCE):
                own = new[i : i + AT_ONCE]
                self.table[first + i : first + i + len(own)] = inputs(self.w, parts_of(own)) @ self.w["input"] + self.w["input_bias"]
        known = self.known
        wins = [windows_of(np.fromiter(map(known.__getitem__, words), np.int64, len(words))) for words in split]
        win = np.concatenate(wins)
        logit = np.concatenate([_forward(self.w, self.table, win[i : i + 1024])[0] for i in range(0, len(win), 1024)])
        rows = np.array([len(x) for x in wins])
        return np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum(rows)[:-1]]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        scale, offset = self.w["tune"].astype(np.float64)
        return 1 / (1 + np.exp(-(self.logits(texts) * scale + offset)))


def tune(w, texts: list[str], labels: np.ndarray) -> None:
    """Move the offset to the cut that errs least on whole texts."""
    if not len(texts) or labels.min() == labels.max():
        return
    scorer = Scorer(w)
    logit = np.concatenate([scorer.logits(texts[i : i + 64]) for i in range(0, len(texts), 64)])
    cuts = np.unique(logit)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    toxic, clean = np.sort(logit[labels > 0]), np.sort(logit[labels <= 0])
    errs = np.searchsorted(toxic, cuts) + len(clean) - np.searchsorted(clean, cuts)
    w["tune"][1] = -float(np.median(cuts[errs == errs.min()]))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights from the bounded sample; ``labels`` must hold no row that is held out."""
    seen = labelled_sample(docs, labels, column, ((0,), (1,)), sample, LONGEST, CHARACTERS)
    texts, label = seen["text"].tolist(), seen["label"].to_numpy(np.float32)
    place = np.empty(len(label), np.int64)  # of each row among those of its kind, in an order that has nothing to do with ids
    mixed = np.random.default_rng(5).permutation(len(label))
    for kind in (0, 1):
        own = mixed[label[mixed] == kind]
        place[own] = np.arange(len(own))
    apart = place % 5 == 4
    w = train([t for t, a in zip(texts, apart, strict=True) if not a], label[~apart])
    tune(w, [t for t, a in zip(texts, apart, strict=True) if a], label[apart])
    return w


def _scored(w):
    def run(it):
        worker_cache("toxicity", dict)  # what other operators keep goes
        scorer = Scorer(w)
        for batch in it:
            texts, out = batch.column(1), []
            for at, to in slices(batch, 1, 400_000):
                out.append(scorer.score(texts.slice(at, to - at).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(weights), "doc_id long, score double")

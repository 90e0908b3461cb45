"""Operator 1: a byte-level convolutional network in numpy for text quality.

Each UTF-8 byte of a text has a learned embedding; learned filters of eight bytes move over them four bytes at a time. In chunks
of 256 bytes that overlap by half and cover the whole text, each filter's largest response is kept (max-pooling), a hidden layer
judges the chunk, and the mean, the least and the greatest of the chunks' judgements are combined into one probability. The
network is trained by Adam on all chunks of a bounded sample of labelled rows (the first ``SAMPLE`` by hash, of at most
``LONGEST`` characters each and ``CHARACTERS`` together). Scoring reads every byte of every text, a block of chunks at a time, and
only the fixed-size weights travel to the executors.

Rows: a null text scores as an empty one, which is one chunk of padding; rows without doc_id are scored too; repeated rows give
a row each, and are one when the sample is drawn; other columns are ignored. Without labels, or with labels of one kind, the network stays near its start and its
score near that kind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import labelled_sample, slices, worker_cache

#: Bytes that a filter moves by, bytes of a chunk (its last half is the next one's first), numbers of a byte's embedding, filters,
#: hidden units; halves of chunks whose responses are made at once when scoring.
STEP, CHUNK, EMBED, FILTERS, HIDDEN, BLOCK = 4, 256, 6, 32, 16, 2048
#: Rows of the sample, characters of one text and of all at most; epochs, texts in a step of training.
SAMPLE, LONGEST, CHARACTERS, EPOCHS, BATCH = 6000, 200_000, 12_000_000, 8, 64


def chunks_of(data: bytes) -> np.ndarray:
    """The bytes of a text as (halves, CHUNK / 2), zeros after the end: chunk i is rows i and i + 1."""
    half = CHUNK // 2
    n = max(2, -(-len(data) // half))
    out = np.zeros(n * half, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, half)


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    scale = lambda *s: (r.standard_normal(s) / np.sqrt(np.prod(s[:-1]))).astype(np.float32)
    return {
        "embed": (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
        "filter": scale(2 * STEP * EMBED, FILTERS) * 1.5,
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": scale(FILTERS, HIDDEN),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "judge": scale(HIDDEN, 1)[:, 0],
        "judge_bias": np.zeros(1, np.float32),
        "combine": np.array([0.5, 1.0, 0.2], np.float32),
        "combine_bias": np.zeros(1, np.float32),
    }


def _responses(w, halves: np.ndarray):
    """Largest response of each filter in each half (whose last filter reaches four bytes into the next), and where."""
    n, half = halves.shape
    x = w["embed"][halves.reshape(-1)].reshape(n * half // STEP, STEP * EMBED)
    a, b = x @ w["filter"][: STEP * EMBED], x @ w["filter"][STEP * EMBED :]
    a[:-1] += b[1:]
    a = a.reshape(n, half // STEP, FILTERS)
    return x, a


def _judged(w, top: np.ndarray, rows: np.ndarray):
    """Logits of texts from the largest responses in each half of theirs."""
    ends = np.cumsum(rows)
    first = np.concatenate([np.arange(e - r, e - 1) for e, r in zip(ends, rows, strict=True)])
    pooled = np.maximum(top[first], top[first + 1])
    f = np.tanh(pooled + w["bias"])
    h = np.tanh(f @ w["hidden"] + w["hidden_bias"])
    z = h @ w["judge"] + w["judge_bias"]
    starts = np.concatenate([[0], np.cumsum(rows - 1)[:-1]])
    mean = np.add.reduceat(z, starts) / (rows - 1)
    least, most = np.minimum.reduceat(z, starts), np.maximum.reduceat(z, starts)
    logit = np.stack([mean, least, most], 1) @ w["combine"] + w["combine_bias"]
    return logit, (first, f, h, z, starts, mean, least, most)


def _forward(w, texts: list[np.ndarray]):
    halves = np.concatenate(texts)
    rows = np.array([len(t) for t in texts])
    x, a = _responses(w, halves)
    a[np.cumsum(rows) - 1, -1] = -1e9  # the last filter of a text would reach into the next text
    top = a.max(1)
    logit, (first, *rest) = _judged(w, top, rows)
    return logit, (halves, rows, x, a, top, first, *rest)


def score(w, data: list[bytes]) -> np.ndarray:
    """Probabilities; memory is bounded by the bytes themselves and one block of responses."""
    texts = [chunks_of(d) for d in data]
    rows, halves = np.array([len(t) for t in texts]), np.concatenate(texts)
    last = np.zeros(len(halves), bool)
    last[np.cumsum(rows) - 1] = True
    top = np.empty((len(halves), FILTERS), w["bias"].dtype)
    for at in range(0, len(halves), BLOCK):
        own = last[at : at + BLOCK]
        a = _responses(w, halves[at : at + BLOCK + 1])[1][: len(own)]  # one half more, into which the last filter reaches
        a[own, -1] = -1e9
        top[at : at + BLOCK] = a.max(1)
    return 1 / (1 + np.exp(-_judged(w, top, rows)[0].astype(np.float64)))


def _gradients(w, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray):
    logit, (halves, rows, x, a, top, first, f, h, z, starts, mean, least, most) = _forward(w, texts)
    p = 1 / (1 + np.exp(-logit))
    d = ((p - label) * weight / len(label)).astype(np.float32)
    g = {"combine": np.stack([mean, least, most], 1).T @ d, "combine_bias": d.sum(keepdims=True)}
    each = rows - 1
    owner = np.repeat(np.arange(len(rows)), each)
    dz = d[owner] * w["combine"][0] / each[owner]
    for column, value in ((1, least), (2, most)):
        own = z == value[owner]
        share = np.add.reduceat(own.astype(np.float32), starts)
        dz += own * d[owner] * w["combine"][column] / share[owner]
    g["judge"], g["judge_bias"] = h.T @ dz, dz.sum(keepdims=True)
    dh = np.outer(dz, w["judge"]) * (1 - h * h)
    g["hidden"], g["hidden_bias"] = f.T @ dh, dh.sum(0)
    df = (dh @ w["hidden"].T) * (1 - f * f)
    g["bias"] = df.sum(0)
    later = top[first + 1] > top[first]
    half = first[:, None] + later
    spot = a.argmax(1)[half, np.arange(FILTERS)]
    at = half * (halves.shape[1] // STEP) + spot  # row of x at which each filter answered most
    dx = np.zeros_like(x)
    g["filter"] = np.zeros_like(w["filter"])
    width = STEP * EMBED
    nxt = np.minimum(at + 1, len(x) - 1)
    for k in range(FILTERS):
        g["filter"][:width, k] = df[:, k] @ x[at[:, k]]
        g["filter"][width:, k] = df[:, k] @ x[nxt[:, k]]
    flat = at.reshape(-1)
    np.add.at(dx, flat, (df[:, :, None] * w["filter"][:width].T[None]).reshape(-1, width))
    np.add.at(dx, nxt.reshape(-1), (df[:, :, None] * w["filter"][width:].T[None]).reshape(-1, width))
    touched = np.unique(np.concatenate([flat, nxt.reshape(-1)]))
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], halves.reshape(-1, STEP)[touched].reshape(-1), dx[touched].reshape(-1, EMBED))
    loss = float(-(weight * (label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9))).mean())
    return loss, g


def train(data: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    w = start_weights(seed)
    if not len(data):
        return w
    r = np.random.default_rng(seed)
    shown = [chunks_of(d) for d in data]
    share = float(labels.mean())
    w["combine_bias"][:] = np.log((share + 0.01) / (1.01 - share))
    weight = np.where(labels > 0, 1.0, min(4.0, max(1.0, share / max(1 - share, 1e-3)))).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, total = 0, epochs * -(-len(data) // BATCH)
    epochs = max(epochs, -(-400 // -(-len(data) // BATCH)))  # small samples are seen more often
    total = epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            _, g = _gradients(w, [shown[j] for j in own], labels[own], weight[own])
            step += 1
            pace = rate * min(1.0, step / 30) * (1 - 0.95 * step / (total + 1))
            for k, (m, v) in moment.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] * g[k] - v)
                w[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights from the bounded sample; ``labels`` must hold no row that is held out."""
    seen = labelled_sample(docs, labels, column, ((0, 1),), sample, LONGEST, CHARACTERS)
    return train([x.encode() for x in seen["text"]], seen["label"].to_numpy(np.float32))


def _scores(w, batch, column: int) -> np.ndarray:
    worker_cache("quality", dict)  # what other operators keep goes
    texts = batch.column(column)
    out = [score(w, [(x or "").encode() for x in texts.slice(at, to - at).to_pylist()]) for at, to in slices(batch, column, 400_000)]
    return np.concatenate(out) if out else np.empty(0)


def _scored(w):
    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(w, batch, 1))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(weights), "doc_id long, score double")


def keep_good(docs: DataFrame, weights: dict[str, np.ndarray], least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``; decided row by row, so equal ids do not matter."""

    place, schema = docs.columns.index("text"), docs.schema

    def run(it):
        for batch in it:
            yield batch.filter(pa.array(_scores(weights, batch, place) >= least))

    return docs.mapInArrow(run, schema)

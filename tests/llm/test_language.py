import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyarc.llm import language as L
from tallyarc.llm import queries


def plain_states(w, data, direction):
    """States of one unit over bytes, one at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    k, h, out = L.HIDDEN, np.zeros(L.HIDDEN), []
    for c in data if direction == 0 else data[::-1]:
        x, s = w["byte"][direction][:, c], w["state"][direction] @ h
        r, z = sigmoid(x[:k] + s[:k]), sigmoid(x[k : 2 * k] + s[k : 2 * k])
        new = np.tanh(x[2 * k :] + r * s[2 * k :])
        h = (1 - z) * new + z * h
        out.append(h)
    return np.array(out if direction == 0 else out[::-1])


def plain_labels(w, data):
    e = np.concatenate([plain_states(w, data, 0), plain_states(w, data, 1)], 1) @ w["label"].T + w["label_bias"]
    e = np.exp(e - e.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def plain_probabilities(w, data):
    n, step = len(data), L.WINDOW - 2 * L.MARGIN
    if not n:
        return np.zeros(len(w["label"]))
    out, at = [], 0
    while True:
        last = at + L.WINDOW >= n
        p = plain_labels(w, data[at : at + L.WINDOW])
        out.append(p[0 if at == 0 else L.MARGIN : n - at if last else L.WINDOW - L.MARGIN])
        if last:
            break
        at += step
    out = np.concatenate(out)
    assert len(out) == n  # every byte is labelled once
    return out.mean(0)


@pytest.fixture(scope="module")
def weights():
    r = np.random.default_rng(1)
    return {k: (v + 0.2 * r.standard_normal(v.shape)).astype(v.dtype) if k != "byte" else v for k, v in L.start_weights(3).items()}


def test_equals_a_plain_network(weights, monkeypatch):
    r = np.random.default_rng(5)
    data = [b"", b"a", "ñandú".encode(), bytes(r.integers(0, 256, 255).astype(np.uint8)), bytes(256), b"xyz" * 86, bytes(r.integers(0, 256, 3000).astype(np.uint8)), b"q" * (256 + 224), b"q" * (257 + 224)]
    want = np.stack([plain_probabilities(weights, d) for d in data])
    assert np.allclose(L.probabilities(weights, data), want, atol=2e-5)
    assert np.allclose(np.concatenate([L.probabilities(weights, [d]) for d in data]), want, atol=2e-5)
    monkeypatch.setattr(L, "BLOCK", 3)
    assert np.allclose(L.probabilities(weights, data), want, atol=2e-5)
    assert np.allclose(L.position_labels(weights, np.frombuffer(data[2], np.uint8)[None].astype(np.int64))[0], plain_labels(weights, data[2]), atol=1e-5)


def test_gradients():
    w = {k: v.astype(np.float64) for k, v in L.start_weights(3).items()}
    r = np.random.default_rng(0)
    win, label = r.integers(97, 105, (5, 12)), np.array([0, 1, 2, 1, 0])
    win[2, 7:] = L.PAD
    _, g = L._gradients(w, win, label)
    for name in w:
        spots = np.argsort(-np.abs(g[name]).reshape(-1))[:6]
        for at in spots:
            flat, keep, loss = w[name].reshape(-1), w[name].reshape(-1)[at], []
            for d in (1e-5, -1e-5):
                flat[at] = keep + d
                loss.append(L._gradients(w, win, label)[0])
            flat[at] = keep
            assert abs((loss[0] - loss[1]) / 2e-5 - g[name].reshape(-1)[at]) < 1e-6
    assert (g["byte"][:, :, L.PAD] == 0).all()


def invented(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))


def test_learns_and_says_und(spark):
    r = random.Random(2)
    kinds = {"aa": "abcdeé", "bb": "uvwxyzß", "cc": "日本語文字列"}
    rows = [(i, invented(r, kinds[k], r.randint(1, 60)), k) for i in range(240) for k in [r.choice(list(kinds))]]
    rows += [(900, "dada", None), (901, None, "aa"), (902, "", "aa"), (903, "12 34!?", "bb"), (904, "²½ 5", "aa"), (None, "abc eéd", "aa"), (905, invented(r, kinds["cc"], 4000), "cc"), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    seen = df.where("doc_id < 160 AND doc_id IS NOT NULL")
    model = L.fit(seen, steps=60)
    assert model[0] == ["aa", "bb", "cc"]
    out = L.languages_of(df, model).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i in (901, 902, 903, 904):
        assert (got[i].lang_pred, got[i].score) == ("und", 0)
    assert got[None].lang_pred == "aa" and got[905].lang_pred == "cc" and 0 < got[905].score <= 1
    held = [(i, k) for i, _, k in rows[:240] if i >= 160]
    assert np.mean([got[i].lang_pred == k for i, k in held]) > 0.95
    assert {r.lang_pred for r in L.languages_of(df, L.fit(df.limit(0))).collect()} == {"und"}
    assert L.languages_of(df.limit(0), model).count() == 0
    texts, langs = L.language_sample(seen, sample=9)
    assert [langs.count(k) for k in kinds] == [3, 3, 3] and len(set(texts)) == 9
    everything, langs = L.language_sample(seen)
    assert sorted(zip(langs, everything)) == sorted({(k, t) for i, t, k in rows if i is not None and i < 160})


def test_query_on_the_held_out_fold(spark, sf_dir):
    out = queries.QUERIES["op12_byte_gru_language"](spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    true = dict(zip(*pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values()))
    rows = out.collect()
    assert len(rows) == len(true) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang_pred == true[r.doc_id] for r in held]) >= 0.95

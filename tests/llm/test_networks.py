import random

import numpy as np

from tallyarc.llm import quality as Q
from tallyarc.llm import toxicity as T

WORDS = "the river runs over stones and under bridges while people walk along with dogs or read books in the warm sun".split()


def prose(r, n=40):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_quality_learns_and_gradients_are_right():
    r = random.Random(0)
    good = [prose(r) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(r).split()) for _ in range(60)] + [" ".join([r.choice(WORDS)] * 40) for _ in range(60)]
    data, label = [x.encode() for x in good + bad], np.array([1] * 120 + [0] * 120, np.float32)
    order = np.random.default_rng(0).permutation(240)
    w = Q.train([data[i] for i in order[:180]], label[order[:180]])
    p = Q.score(w, [data[i] for i in order[180:]])
    assert ((p >= 0.7) == label[order[180:]]).mean() >= 0.9
    texts = [Q.chunks_of(d) for d in data[:6]]
    w = {k: v.astype(np.float64) for k, v in Q.start_weights().items()}
    y, one = label[:6].astype(np.float64), np.ones(6)
    _, g = Q._gradients(w, texts, y, one)
    for name in ("filter", "hidden", "judge", "combine", "embed"):
        flat = w[name].reshape(-1)
        at = int(np.abs(g[name]).argmax())
        keep = flat[at]
        loss = []
        for d in (1e-5, -1e-5):
            flat[at] = keep + d
            loss.append(Q._gradients(w, texts, y, one)[0])
        flat[at] = keep
        assert abs((loss[0] - loss[1]) / 2e-5 - g[name].reshape(-1)[at]) < 1e-3 + 0.05 * abs(g[name]).max()


def test_toxicity_learns_words_parts_and_long_texts():
    r = random.Random(1)
    clean = [prose(r, r.randint(5, 120)) for _ in range(150)]
    toxic = []
    for i in range(150):
        words = prose(r, r.randint(5, 120)).split()
        words[r.randrange(len(words))] = r.choice(["vilest", "scumbag"]) if i % 2 else "zorkel" + r.choice(["ing", "ed", "ation", "ous"]) + r.choice("abcd")
        toxic.append(" ".join(words))
    texts, label = clean + toxic, np.array([0] * 150 + [1] * 150, np.float32)
    order = np.random.default_rng(0).permutation(300)
    w = T.train([texts[i] for i in order[:240]], label[order[:240]])
    T.tune(w, [texts[i] for i in order[:240]], label[order[:240]])
    scorer = T.Scorer(w)
    p = scorer.score([texts[i] for i in order[240:]])
    assert ((p >= 0.5) == label[order[240:]]).mean() >= 0.9
    long = prose(r, 3000)
    assert scorer.score([long + " zorkelingx " + long, ""]).shape == (2,)
    assert scorer.score([long + " zorkelinga " + long])[0] > scorer.score([long])[0]
    assert np.allclose(scorer.score(texts[:5]), np.concatenate([T.Scorer(w).score([t]) for t in texts[:5]]))


def test_quality_equals_a_plain_forward_pass(monkeypatch):
    r = np.random.default_rng(4)
    w = {k: v + 0.1 * r.standard_normal(v.shape).astype(np.float32) for k, v in Q.start_weights().items()}
    data = [b"", b"abc", bytes(range(256)) * 3, b"x" * 129, bytes(r.integers(0, 256, 5000).astype(np.uint8))]

    def plain(d):
        d = d + bytes(max(256, -(-len(d) // 128) * 128) - len(d))
        z = []
        for at in range(0, len(d) - 128, 128):
            # A filter that starts in the last four bytes of a chunk reads on into the next one, if the text has one.
            spots = [s for s in range(at, at + 256, 4) if s + 8 <= len(d)]
            both = np.array([w["embed"][list(d[s : s + 8])].reshape(-1) @ w["filter"] for s in spots])
            h = np.tanh(np.tanh(both.max(0) + w["bias"]) @ w["hidden"] + w["hidden_bias"])
            z.append(h @ w["judge"] + w["judge_bias"][0])
        return 1 / (1 + np.exp(-(np.array([np.mean(z), min(z), max(z)]) @ w["combine"] + w["combine_bias"][0])))

    want = [plain(d) for d in data]
    assert np.allclose(Q.score(w, data), want, atol=1e-5)
    monkeypatch.setattr(Q, "BLOCK", 3)
    assert np.allclose(Q.score(w, data), want, atol=1e-5)


def test_quality_on_held_out_rows(spark):
    from tallyarc.llm.common import table
    from tallyarc.llm.queries import held_out

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").where("quality is not null")
    w = Q.fit(docs, labels.where(~held_out(4, 2)))
    apart = docs.join(labels.where(held_out(4, 2)), "doc_id")
    got = Q.quality_scores(apart, w).join(apart.select("doc_id", "quality"), "doc_id").selectExpr("quality", "score >= 0.7 AS kept").toPandas()
    assert (got.kept == (got.quality == 1)).mean() >= 0.985


def test_toxicity_gradients_and_a_plain_forward_pass():
    r = np.random.default_rng(3)
    w = {k: v.astype(np.float64) + (0.3 * r.standard_normal(v.shape) if k in ("form", "gram") else 0) for k, v in T.start_weights().items()}
    texts = ["alpha beta gamma", "delta", "beta beta " * 30]
    words = list(dict.fromkeys(x for t in texts for x in T.words_of(t)))
    parts = T.parts_of(words)
    win = np.concatenate([T.windows_of(np.array([words.index(x) for x in T.words_of(t)])) for t in texts])
    left_in = np.ones((len(words), 2), bool)
    d = np.linspace(-1, 1, len(win))

    def loss():
        return float(T._forward(w, T.inputs(w, parts).astype(np.float64) @ w["input"] + w["input_bias"], win)[0] @ d)

    x = T.inputs(w, parts).astype(np.float64)
    logit, kept = T._forward(w, x @ w["input"] + w["input_bias"], win, keep=True)
    g = T._gradients(w, parts, win, d, x, left_in, kept)
    for name in ("form", "gram", "input", "input_bias", "state", "attend", "attend_to", "judge"):
        flat = w[name].reshape(-1)
        at = int(np.abs(g[name]).argmax())
        keep, step, two = flat[at], 3e-3, []
        for sign in (1, -1):
            flat[at] = keep + sign * step
            two.append(loss())
        flat[at] = keep
        assert abs((two[0] - two[1]) / (2 * step) - g[name].reshape(-1)[at]) < 2e-3 + 0.03 * abs(g[name]).max(), name

    def plain(own):
        """One window word by word, by the equations."""
        sig = lambda z: 1 / (1 + np.exp(-z))
        h = T.HIDDEN
        into = [x[i] @ w["input"] + w["input_bias"] for i in own]
        both = np.zeros((len(own), 2 * h))
        for way, order in ((0, range(len(own))), (1, reversed(range(len(own))))):
            s = np.zeros(h)
            for t in order:
                a, b = into[t][3 * h * way : 3 * h * (way + 1)], s @ w["state"][way]
                reset, keep_ = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                new = np.tanh(a[2 * h :] + reset * b[2 * h :])
                s = (1 - keep_) * new + keep_ * s
                both[t, h * way : h * (way + 1)] = s
        e = np.tanh(both @ w["attend"] + w["attend_bias"]) @ w["attend_to"]
        e = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return (e @ both) @ w["judge"] + w["judge_bias"][0]

    assert np.allclose(logit, [plain(row[row >= 0]) for row in win], atol=1e-4)


def test_toxicity_on_held_out_rows(spark):
    """On rows whose labels training has not seen: few clean ones are flagged, most toxic ones found (some labels follow no word)."""
    from tallyarc.llm.common import table
    from tallyarc.llm.queries import held_out

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").where("toxic is not null")
    w = T.fit(docs, labels.where(~held_out(5, 0)))
    apart = docs.join(labels.where(held_out(5, 0)), "doc_id")
    got = T.toxicity_scores(apart, w).join(apart.select("doc_id", "toxic"), "doc_id").selectExpr("toxic", "score >= 0.5 AS hit").toPandas()
    assert got.hit[got.toxic == 1].mean() >= 0.85 and got.hit[got.toxic == 0].mean() <= 0.03


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        win = T.windows_of(np.arange(n))
        assert set(win[win >= 0].tolist()) == set(range(n))


def test_scores_every_row(docs, rows, nothing):
    for out in (Q.quality_scores(docs, Q.start_weights()), T.toxicity_scores(docs, T.start_weights())):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert Q.quality_scores(nothing, Q.start_weights()).count() == 0 == T.toxicity_scores(nothing, T.start_weights()).count()
    assert Q.keep_good(docs, Q.start_weights(), 0.0).count() == len(rows)


def test_fit_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(Q.fit(docs, labels)) == set(Q.start_weights())
    assert set(T.fit(docs, labels)) == set(T.start_weights())
    one = spark.createDataFrame([(3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert np.isfinite(Q.score(Q.fit(docs, one), [b"x"])).all() and np.isfinite(T.Scorer(T.fit(docs, one)).score(["x"])).all()


def test_held_out_rows_do_not_matter(spark):
    """Labels of the held-out fold can be anything."""
    from pyspark.sql import functions as F

    from tallyarc.llm.queries import held_out

    df = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out(4, 2))
    import zlib

    assert {r.doc_id for r in df.where("h").collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert df.where(~F.col("h")).count() > 100


def test_toxicity_reads_long_words_whole():
    r = random.Random(2)
    run = "".join(chr(r.randint(97, 122)) for _ in range(333))
    parts = T.words_of(f"a {run} b")
    assert parts[0] == b"a" and parts[-1] == b"b" and max(map(len, parts)) <= T.LONGEST_WORD
    for i in range(len(run) - 19):
        assert any(run[i : i + 20].encode() in x for x in parts)
    assert len(set(T.words_of("仇" * 30 + "恨" * 30))) > 2
    clean = [prose(r, r.randint(5, 120)) for _ in range(150)]
    toxic = [" ".join([*prose(r, 20).split(), "zorkel" + r.choice(["ing", "ed", "ation"]), *prose(r, 20).split()]) for _ in range(150)]
    w = T.train(clean + toxic, np.array([0] * 150 + [1] * 150, np.float32))
    scorer = T.Scorer(w)
    long = "_".join(prose(r, 30).split())
    assert scorer.score([f"{long}_zorkeling_{long}"])[0] > scorer.score([f"{long}_{long}"])[0]

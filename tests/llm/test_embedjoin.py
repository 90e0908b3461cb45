import numpy as np
from pyspark.sql import functions as F

from tallyarc.llm import embedjoin as E


def brute(x, ids, t):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = u @ u.T >= t
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return near.sum(1), label
        label = new


def test_equals_brute_force(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((6, 16))
    x = np.concatenate([centres[r.integers(0, 6, 160)] + 0.15 * r.standard_normal((160, 16)), np.repeat(centres[:1], 40, 0), 3 * centres[:1], r.standard_normal((40, 16))])
    ids = r.permutation(len(x)).astype(np.int64) + 1
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)]
    bad = [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [0.0] * 15), (1006, [1.0, 2.0]), (1007, [])]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>")
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in E.near_vectors(df, 0.95, block=64).collect()}
    links, label = brute(x, ids, 0.95)
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, links, label, strict=True)}
    assert got == want | {i: (0, i, True) for i, _ in bad}


def test_empty_and_all_bad(spark):
    schema = "vec_id long, embedding array<float>"
    assert E.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in E.near_vectors(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1, True)]


def test_blocks_skip_nothing():
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 8))
    u = x / np.sqrt((x * x).sum(1))[:, None]
    ids, ones = np.arange(700), np.ones(700, np.int64)
    basis = np.linalg.qr(r.standard_normal((8, 3)))[0]
    _, links, forest = E.join_blocks((ids, ones, x), None or (ids, ones, x), True, 0.8, np.sqrt(0.4), basis)
    want = (u @ u.T >= 0.8).sum(1) - 1
    assert (links == want).all() and len(forest) <= len(ids)


def test_every_length_is_joined(spark):
    r = np.random.default_rng(4)
    rows, want, at = [], {}, 1
    for dim, n in ((16, 60), (8, 40), (3, 2)):
        x = np.repeat(r.standard_normal((n // 2, dim)), 2, 0)
        x[1::4] += 0.01 * r.standard_normal(x[1::4].shape)
        ids = np.arange(at, at + n)
        links, label = brute(x, ids, 0.95)
        rows += [(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)]
        want |= {int(i): (int(k), int(c), bool(i == c)) for i, k, c in zip(ids, links, label, strict=True)}
        at += n
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in E.near_vectors(df, 0.95, block=16).collect()}
    assert got == want and all(n for n, _, _ in want.values())


def test_a_row_for_each_row(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (None, None), (3, None), (3, [0.0, 1.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame([(*x, 7, "k", 1) for x in rows], "vec_id long, embedding array<double>, rep int, key string, n int")
    got = sorted((tuple(r) for r in E.near_vectors(df).collect()), key=str)
    want = [(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True), (4, 2, 1, False)] + [(None, 0, None, True)] * 2
    assert got == sorted(want, key=str)


def test_blocks_are_sent_once_a_band(spark, monkeypatch):
    """Where no pair of blocks can be skipped, the vectors that are sent do not grow with the number of pairs."""
    r = np.random.default_rng(7)
    x = r.standard_normal((800, 12))
    x[1::40] = x[::40] + 0.01 * r.standard_normal((20, 12))
    ids, sent, plain = np.arange(1, 801), spark.sparkContext.accumulator(0), E._joined

    def counted(*args):
        run = plain(*args)

        def rows(it):
            def each():
                for batch in it:
                    for name in batch.schema.names:
                        if name.startswith("x"):
                            sent.add(sum(len(v) for v in batch[name].to_pylist()))
                    yield batch

            yield from run(each())

        return rows

    monkeypatch.setattr(E, "_joined", counted)
    df = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {v.vec_id: (v.n_links, v.component_id) for v in E.near_vectors(df, 0.95, block=10).collect()}
    links, label = brute(x, ids, 0.95)
    assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, links, label, strict=True)} and links.sum() >= 40
    assert sent.value <= 8 * x.nbytes  # each of 80 blocks with each of 7 bands; by pairs it was 80 times
    many = E._sent(spark.range(40).select(F.col("id").alias("seq")), spark.sql("SELECT x.id AS a, y.id AS b FROM range(40) x JOIN range(40) y ON x.id <= y.id"), 40, 2).collect()
    own = {}
    for v in many:
        own.setdefault(v.tile, []).append((v.seq, v.held, v.meets))
    met = [(a, b) for rows in own.values() for a, held, _ in rows if held for b, _, meets in rows if meets and a <= b]
    assert sorted(met) == [(a, b) for a in range(40) for b in range(a, 40)] and max(len(v) for v in own.values()) <= 4

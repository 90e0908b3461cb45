import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallyarc.llm import queries
from tallyarc.llm.periodic import islands, lag_counts, looped, periodic_runs, repeats, room, runs_of, scan


def brute(seq, least=6, times=4):
    n, out = len(seq), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q):
                s = seq[i : j + q]
                if not any(all(s[k] == s[k + d] for k in range(size - d)) for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(r):
    n, kinds = r.choice([0, 1, 5, 6, 7, 8, 20, 40, 80, 200]), r.choice([1, 2, 3, 8, 50])
    s = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randrange(4) if n > 6 else 0):
        a, p = r.randrange(n), r.randrange(1, max(2, n // 4))
        for i in range(a, min(n, a + r.randrange(n))):
            if i - p >= a:
                s[i] = s[i - p]
    return s


def test_runs_and_counts_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        s = sequence(r)
        seq = np.array(s, np.int64)
        assert runs_of(seq) == brute(s)
        assert runs_of(seq, 4, 2) == brute(s, 4, 2)
        if len(s) > 4:
            most = len(s) // 4
            assert lag_counts(seq, most)[1:].tolist() == [sum(s[i] == s[i + q] for i in range(len(s) - q)) for q in range(1, most + 1)]


def test_heavy_and_light_words_and_long_lags():
    r = np.random.default_rng(2)
    s = np.minimum(r.zipf(1.3, 3000), 400)
    s[1000:2200] = np.tile(r.integers(0, 400, 150), 8)
    s[2500:2600] = 7
    seq = np.unique(s, return_inverse=True)[1].astype(np.int64)
    want = [int((s[q:] == s[:-q]).sum()) for q in range(1, 751)]
    assert lag_counts(seq, 750)[1:].tolist() == want
    got = runs_of(seq)
    assert any(q == 150 and size >= 1200 for _, size, q in got) and any(q == 1 and size >= 100 for _, size, q in got)
    for q in (9, 50, 150):  # sampled places miss no island
        same, least = np.concatenate([[0], s[q:] == s[:-q], [0]]).astype(int), 3 * q
        edge = np.flatnonzero(np.diff(same))
        assert islands(seq, q, least) == [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def test_one_word_repeated_is_scanned_once():
    assert runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs_of(np.tile(np.arange(3), 50_000)) == [(0, 150_000, 3)]


def test_sizes_of_transforms():
    for n in range(1, 500):
        size = room(n)
        assert size >= n
        for p in (2, 3, 5):
            while size % p == 0:
                size //= p
        assert size == 1


def words(t):
    return (t or "").translate({c: " " for c in range(9, 14)}).split(" ")


def expected(doc_id, text):
    w = [x for x in words(text) if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


@pytest.fixture(scope="module")
def looping(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab c dd e f gg".split(" ")) for _ in range(r.choice([3, 8, 30, 90])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 5000), (204, "ja nein " * 6 + "　 ja"), (205, "one\x0btwo\x0cthree"), (None, "a a a a a a"), (4, rows[4][1]), (4, rows[4][1])]
    return rows, spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, n_words int, runs string")


def test_query_equals_brute_force(looping, spark, tmp_path):
    rows, df = looping
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*x) for x in rows), key=str)


def test_real_outputs(looping):
    rows, df = looping
    got = periodic_runs(df, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == scan(r.text)
    assert repeats(8, [(0, 8, 2)]).tolist() == [False, False] + [True] * 6
    with pytest.raises(ValueError):
        periodic_runs(df, times=1)


def test_empty(nothing):
    assert periodic_runs(looped(nothing)).count() == 0

import itertools
import random

import numpy as np
import pytest

from tallyarc.llm import jaccard as J


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        both = len(a & b)
        if a and b and den * both >= num * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60)])
def test_equals_brute_force(docs, rows, k, num):
    got = J.jaccard_components(docs, k, num, 100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(rows, k, num, 100)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_large_group(spark):
    """A group of near copies around one text, some of which link only through others."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(words)))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 4, 85, 100)


def test_empty(nothing):
    assert J.jaccard_components(nothing, 4, 85, 100).count() == 0


def test_guarantee_of_schemes():
    """Linked sets share a signature, whatever the allocation."""
    r = np.random.default_rng(2)
    for counts in ({}, {b: 10**6 for b in range(40)}, {b: 10**9 for b in range(40)}):
        plan = J.Scheme(80, 100, counts)
        for _ in range(150):
            n = int(r.integers(1, 120))
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            gone = int(r.integers(0, max(1, len(a) // 6) + 1))
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, int(r.integers(0, 3))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(plan.signatures(a)[0], plan.signatures(b)[0]))


def test_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(100):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 300))).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], r.integers(0, 1 << 63, int(r.integers(1, 200))).astype(np.uint64)]))
        both = J.folded([J.sketch(a), J.sketch(b)])
        assert np.bitwise_count(both[0] ^ both[1]).sum() <= len(np.setxor1d(a, b))


def test_filter_keeps_one_of_each_group(docs, rows):
    kept = [r.doc_id for r in J.keep_first_of_group(docs, 5, 80, 100).collect()]
    want = {c for i, (n, c) in brute(rows, 5, 80, 100).items()}
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 1


def test_filter_decides_by_row(spark):
    """One doc_id with other texts: each text that copies nothing stays."""
    r = random.Random(7)
    a, b, c = (" ".join(f"{x}{r.randrange(9999)}" for _ in range(80)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (2, c), (3, c), (3, c), (4, ""), (4, "")]
    kept = J.keep_first_of_group(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert sorted(tuple(x) for x in kept) == sorted([(1, a), (1, b), (2, c), (4, "")])

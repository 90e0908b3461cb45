import random

from tallyarc.llm.common import Scratch, bitmap, components, in_bitmap


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(500, i) for i in range(501, 540)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    want = {v: find(v) for e in edges for v in e if any(v in x and x[0] != x[1] for x in edges)}
    assert {r.v: r.c for r in got.collect()} == want


def test_bitmap_lets_all_members_through(spark):
    import numpy as np

    ids = [3, -5, 1 << 40, -(1 << 62)]
    words = bitmap(spark.createDataFrame([(i,) for i in ids], "x long"), "x", 12, spark)
    assert in_bitmap(words.value, np.array(ids)).all() and in_bitmap(words.value, np.arange(4096)).sum() <= 8


def test_a_sweep_gives_memory_of_the_driver_back(spark, monkeypatch):
    from tallyarc.llm import common

    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(True))
    common.Scratch(spark, "swept").sweep()
    assert given

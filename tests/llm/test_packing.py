import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyarc.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(rows):
    odd = ["It's. a,b ,. x,. don't, é, É. ÇA İi ΣΑΣ. <|endoftext|>, <|ENDOFTEXT|> é, ́x ŒUVRE ÿß, 12,5 x1, 'll. ﬁ K", "a$$$ é!! x'. x's. a.b. \"w\". ÷, ×. ñ) (z) e-mail. 5% a%b ca|b| b|", "日本語。 テスト, 1²3", "a" * 3000 + ", "]
    texts = [t or "" for _, t, _ in rows] + odd
    own = Tokenizer.from_file(PATH)
    encoder = P.WordEncoder(PATH)
    assert [list(x) for x in encoder.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, rows, capacity):
    got = P.pack(docs, PATH, capacity, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    own = Tokenizer.from_file(PATH)
    once = {i: t for i, t, _ in rows}
    for doc_id, t in once.items():
        if doc_id in (None, 1):
            continue
        ids = sum((r.ids for r in sorted(by_doc[doc_id], key=lambda r: r.piece)), [])
        assert ids == own.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(r.start == r.piece * capacity for r in by_doc[doc_id])
    assert len(by_doc[1]) == 2 * len([r for r in by_doc[1] if r.piece >= 0]) // 2 and len(by_doc[None]) >= 1
    total = sum(r.length for r in got)
    assert len(by_sequence) >= -(-total // capacity)


def test_plan_holds_all_and_fits():
    r = random.Random(0)
    for _ in range(20):
        counts = {r.randint(1, 200): r.randint(1, 50) for _ in range(r.randint(0, 60))}
        used = defaultdict(int)
        for n, lengths in P.plan(counts, 200):
            assert n > 0 and sum(lengths) <= 200
            for x in lengths:
                used[x] += n
        assert dict(used) == counts


def test_exact_complements_are_found():
    assert P.plan({150: 3, 50: 3}, 200) == [(3, [150, 50])]
    assert P.plan({100: 2, 60: 2, 40: 2}, 200) == [(2, [100, 60, 40])] or len(P.plan({100: 2, 60: 2, 40: 2}, 200)) == 2
    assert sum(n for n, _ in P.plan({90: 1, 50: 1, 40: 1, 20: 1}, 200)) == 1


def test_empty(nothing):
    assert P.pack(nothing, PATH).count() == 0
    assert np.array_equal(P.WordEncoder(PATH).encode(["", None])[1], np.empty(0, np.uint32))


def best_fit(counts, capacity):
    """How many sequences plain best fit, longest first, takes."""
    free = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = min((i for i, f in enumerate(free) if f >= x), key=lambda i: free[i], default=None)
        if at is None:
            free.append(capacity - x)
        else:
            free[at] -= x
    return len(free)


def optimum(lengths, capacity):
    """The fewest sequences, by trying all placements of a few pieces."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for f in sorted({*free, capacity}):
            if f >= lengths[i]:
                rest = list(free)
                if f in rest:
                    rest.remove(f)
                    place(i + 1, [*rest, f - lengths[i]])
        place(i + 1, [*free, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_as_few_sequences_as_best_fit_and_nearly_the_optimum():
    r = random.Random(5)
    for _ in range(40):
        counts = {r.randint(1, 100): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        assert sum(n for n, _ in P.plan(counts, 100)) <= best_fit(counts, 100) + 1
    worse = 0
    for _ in range(150):
        counts = defaultdict(int)
        for _ in range(r.randint(1, 8)):
            counts[r.randint(5, 60)] += 1
        got, least = sum(n for n, _ in P.plan(dict(counts), 100)), optimum([x for x, n in counts.items() for _ in range(n)], 100)
        assert least <= got <= least + 1
        worse += got > least
    assert worse <= 8

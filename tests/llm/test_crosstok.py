import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tallyarc.llm import crosstok as X
from tallyarc.llm import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "one two", "don't  you'll\nI've\n\n two", "tab\tbed \t x", "a\n b", "a \nb", "x\r\ny ", "<|endoftext|> is plain", "<s> </s> <unk> <0x41>",
    "mark▁inside", "▁", "日本語のテキスト と 空白", "ﬁne ｱ² Å é é", "\x00 nul \x1c \x85 \xa0 b", "emoji 👩‍👩‍👧 🇩🇪 end", "ａ　ｂ", "x" * 3000, "a" * 50 + " " * 50 + "b", "12345 67,890.12 $5", "word " * 200, "̈ combining",
]


def plain(texts):
    """Whole texts through the libraries, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    code = X.byte_level()
    rows, links = [], []
    for t in texts:
        if not t:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        ab = [bytes(code[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(b_tok.id_to_piece(i)[3:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        text, lo = [], 0
        for c in cuts:
            part = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if lo < e <= c)  # noqa: E731, B023
            text.append(f"{part(a, ends_a)}|{part(b, ends_b)}")
            lo = c
        links.append([(i, j) for i, x in zip(a, ends_a) for j, y in zip(b, ends_b) if x == y] if len(a) < 300 else [(dict(zip(ends_a, a))[c], dict(zip(ends_b, b))[c]) for c in cuts])
        rows.append((len(a), len(b), len(cuts), len(links[-1]), hashlib.sha256(";".join(text).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(rows, links)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    pool = "the of and stone river's Über-maß niño, (brackets) x=1; https://a.b/c?d=e 3.14 — “quote” \n\t foo_bar CamelCase".split(" ")
    return [*ODD, *[r.choice([" ", "  ", "\n", ". "]).join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(120)]]


def test_aligner_equals_the_libraries(texts):
    own = X.Aligner(A, B)
    assert own.parted
    want = plain(texts)
    for size in (1, 7, len(texts)):  # what is remembered changes nothing
        got = []
        for i in range(0, len(texts), size):
            n_a, n_b, n_links, digests, keys = own.align(texts[i : i + size])
            assert len(keys) == n_links.sum()
            got += zip(n_a.tolist(), n_b.tolist(), n_links.tolist(), digests)
        assert got == [(w[0], w[1], w[3], w[6]) for w in want]
    own.parted = False
    own.forget_pairs()
    n_a, n_b, n_links, digests, _ = own.align(texts)
    assert list(zip(n_a.tolist(), n_b.tolist(), n_links.tolist(), digests)) == [(w[0], w[1], w[3], w[6]) for w in want]


def test_query_equals_the_libraries(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(X, "LINKS", 500)  # several chunks
    monkeypatch.setattr(X, "PAIRS", 50)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (30, texts[30]), (30, texts[30])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, chunk int, pairs string, n_a int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_cross_tokenizer"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(0 < w[5] < w[4] for w in want)
    assert sorted(map(tuple, X.aligned(df, A, B, stripes=7).collect()), key=str) == sorted(want, key=str)


def test_numbers_survive():
    r = np.random.default_rng(0)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            x = r.integers(0, 1 << 31, n).astype(kind)
            assert (X.numbers(X.planes(x), kind) == x).all()


def test_empty(nothing):
    assert X.aligned(nothing, A, B).count() == 0

import random

import numpy as np
import public_tokenizers
import pytest

from tallyarc.llm import sptok as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return S.Unigram(PATH)


def brute(m, run):
    pieces = {t.encode(): i for i, t in enumerate(m.texts) if m.types[i] in (1, 4)}
    best = [0.0] + [-1e18] * len(run)
    for i in range(len(run)):
        if best[i] < -1e17 or run[i] & 0xC0 == 0x80:
            continue
        size = 1 + (run[i] >= 0xC0) + (run[i] >= 0xE0) + (run[i] >= 0xF0)
        best[i + size] = max(best[i + size], best[i] + m.fallback)
        for j in range(i + 1, min(len(run), i + m.longest) + 1):
            if run[i:j] in pieces:
                best[j] = max(best[j], best[i] + m.score[pieces[run[i:j]]])
    return best[-1]


def test_round_trip(model, rows):
    texts = [t or "" for _, t, _ in rows] + [" a  b\n c\t", "日本語 ☃ 🙂 x", "   ", " x", "a\u0000b", "é" * 300]
    ids = model.encode(texts)
    assert [model.decode(x) for x in ids] == texts
    assert model.encode(texts)[0].tolist() == ids[0].tolist()


def test_best_score(model):
    r = random.Random(0)
    texts = ["".join(r.choice("abcdeé ☃the ing") for _ in range(r.randint(1, 60))) for _ in range(200)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert abs(sum(brute(model, run) for run in model._runs(text)) - S.log_score(model, ids)) < 1e-6


def test_same_as_the_library_on_a_unigram_model(tmp_path):
    """The library, given the same pieces and scores as a unigram model, finds segmentations of the same score."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = float(-np.log(-p.score + 2))
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), S.Unigram(path)
    r = random.Random(0)
    for _ in range(100):
        text = "".join(r.choice("abcdefghij the of and ing") for _ in range(r.randint(1, 50))).strip() or "x"
        theirs = np.array(lib.encode(text), np.int32)
        assert abs(sum(own.score[theirs]) - sum(own.score[own.encode([text])[0]])) < 1e-3


def test_double_array():
    r = random.Random(1)
    keys = sorted({bytes(r.choice(b"abcdefg") for _ in range(r.randint(1, 6))) for _ in range(800)})
    trie = S.DoubleArray(keys, list(range(len(keys))))
    for i, key in enumerate(keys):
        state = 0
        for b in key:
            nxt = trie.base[state] + b
            assert trie.check[nxt] == state
            state = nxt
        assert trie.piece[state] == i


def test_rows(docs, rows, nothing):
    got = S.encode(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert S.encode(nothing, PATH).count() == 0

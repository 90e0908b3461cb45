import random

import numpy as np

from tallyarc.llm.passages import GRAM, WORDS, anchors, passage_dedup, without


def brute(rows):
    first, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        words, gone = t.split(), set()
        for p in range(len(words) - WORDS + 1):
            w = tuple(words[p : p + WORDS])
            fi, fp = first.setdefault(w, (i, p))
            if (fi, fp) != (i, p):
                gone |= set(range(p, p + WORDS)) - (set(range(fp, fp + WORDS)) if fi == i else set())
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def texts(seed=3):
    r = random.Random(seed)
    say = lambda n: [r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(n)]
    shared = [say(n) for n in (49, 50, 53, 130)]
    out = [" ".join(say(300))]
    for i in range(24):
        words = say(r.randint(0, 90)) + shared[i % 4] + say(r.randint(0, 90))
        out.append("".join(w + r.choice([" ", " ", " ", "\n", "\n\n"] if i % 3 else [" "]) for w in words))
    return [*out, "ha " * 400, "ha " * 60, "ho hi " * 200, "", None, " ".join(shared[3]), " ".join(shared[3] * 3)]


def test_finds_passages_inside_lines_as_brute_force_does(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, rows[3], (None, rows[4][1])], "doc_id long, text string")
    got = passage_dedup(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        assert r.text == rows[4][1] if r.doc_id is None else (r.text or "").split() == want[r.doc_id]
    assert sum(len(want[i]) < len((t or "").split()) for i, t in rows) > 15


def test_pipeline_drops_a_passage_inside_one_line(spark):
    import corpus_pipeline as C

    r = random.Random(5)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randint(0, 9999)) for _ in range(n))
    passage = say(80)
    rows = [(i, f"{say(200)} {passage} {say(200)}", "en", "s", 0) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = C.STAGES[1][1](spark, df, "")
    got = {x.doc_id: x for x in C.STAGES[2][1](spark, clean, "").collect()}
    assert passage in got[1].text and passage.split()[40] not in got[2].text.split() and got[2].n_chars == len(got[2].text)
    assert len(got[2].text.split()) == 400


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(0)
    a, b, run = r.integers(0, 2**63, 90, np.uint64), r.integers(0, 2**63, 70, np.uint64), r.integers(0, 2**63, WORDS, np.uint64)
    x, y = anchors(np.concatenate([a, run])), anchors(np.concatenate([b, run, a]))
    assert any(p >= 90 for p in x[2]) and set(x[0][x[2] >= 90].tolist()) & set(y[0].tolist())
    assert GRAM < WORDS


def test_line_feeds_stay():
    assert without("a b\nc d\ne", [1], [-1], 2) == "a\nd\ne" and without("a b c", [0], [-1], 3) == ""


def test_a_very_common_passage_is_found_without_a_join_of_its_anchors(spark, monkeypatch):
    r = random.Random(7)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randint(0, 9999)) for _ in range(n))
    passage = say(60)
    rows = [(i, f"{say(20)} {passage} {say(20)}") for i in range(300)]
    df, joined = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, on=None, how=None: joined.append(how) or plain(self, other, on, how))
    got = {x.doc_id: x.text.split() for x in passage_dedup(df).collect()}
    assert got == brute(rows) and sum(len(x) for x in got.values()) < 300 * 45
    assert "left_semi" not in joined


def test_empty(nothing):
    assert passage_dedup(nothing).count() == 0

import math

import pytest
from pyspark.sql import functions as F

from tallyarc.functions import compact as C
from tallyarc.functions.durations import days, window_days
from tallyarc.functions.text import Porter, dedup_tokens, query_tokens
from tallyarc.functions.wordpiece import pieces


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"), ("cease", "ceas"), ("controll", "control"), ("sky", "sky"), ("happy", "happi")],
)
def test_porter(word, stem):
    assert Porter().stem(word) == stem


def test_query_tokens():
    assert query_tokens("The quick, brown a FOX") == ["quick", "brown", "fox"]
    assert query_tokens("what is it") == ["what", "is", "it"]
    assert query_tokens("") == []
    assert dedup_tokens("one two") == []
    assert dedup_tokens("alpha beta gamma delta epsilon zeta")[-1] == "epsilon"


def test_durations():
    assert (days("2w"), days("3m"), window_days(""), window_days("12"), window_days("1D")) == (14, 90, 30, 12, 1)
    with pytest.raises(ValueError):
        days("x")


def test_wordpieces():
    vocab = {"un", "##aff", "##able", "!", "a"}
    assert pieces("Unaffable! a", vocab) == ["un", "##aff", "##able", "!", "a"]
    assert pieces("zzz", vocab) == ["[UNK]"]
    assert pieces("", vocab) == []


ARRAYS = [
    '[{"a":1,"b":"x"},{"a":2}]',
    '[{"a":null,"b":"x,y\\"z"},{"a":2.5,"b":""},{"c":[1,2]}]',
    '[{"a":"\\\\N","k":true},{"a":"line\\nbreak","k":null}]',
    '[{"a":1},{"a":"1"}]',
]


@pytest.mark.parametrize("text", ARRAYS)
def test_crush_round_trip(text):
    import json

    assert json.loads(C.restore(C.crush(text))) == json.loads(text)


def test_crush_refuses():
    assert C.crush("[1, 2]") is None
    assert C.crush("x") is None
    assert C.crush('[{"a": 1}]') is None
    assert C.restore("no header") is None


def test_strategies():
    assert C.detect('[{"a":1},{"a":2}]') == "json"
    assert C.detect("--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y") == "diff"
    assert C.detect("a.py:1:x\nb.py:2:y") == "search"
    assert C.detect("plain\nlines") == "log"


def test_log():
    lines = [f"info: step {i}" for i in range(100)] + ["ERROR: it broke", "  at f (x.js:1)", "== 3 failed =="]
    out = C.compress_log("\n".join(lines))
    assert "it broke" in out and "== 3 failed ==" in out and len(out) < len("\n".join(lines))
    assert C.compress_log("short") == "short"
    assert C.level("a warning then error") == "warn"
    assert C.dedupe_key("took 12: 34 ms, 56") == "took 12: # ms, #"


def test_matches_and_diff():
    text = "\n".join(f"f{i % 20}.py:{i}:value error {i}" for i in range(200))
    out = C.compress_matches(text, "error")
    assert 0 < len(out.split("\n")) < 100
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n" + "\n".join(f"@@ -{i},3 +{i},3 @@\n c\n-old {i}\n+new {i}\n c\n c" for i in range(40))
    small = C.compress_diff(diff)
    assert "hunks omitted" in small and len(small) < len(diff)


def test_store():
    s = C.Store(capacity=2, seconds=10)
    keys = [s.put(x, 0.0) for x in ("a", "b", "c")]
    assert s.get(keys[0], 1.0) is None and s.get(keys[2], 1.0) == "c" and s.get(keys[2], 11.0) is None
    assert C.marked_key(C.marker("c")) == keys[2]


def test_adaptive_k():
    assert C.adaptive_k(["a"] * 5) == 5
    assert C.adaptive_k(["same line"] * 50, least=3) == 3
    assert C.simhash64("abc") == C.simhash64("ABC")
    assert not math.isnan(C.adaptive_k([f"row {i} {i * 7}" for i in range(40)], bias=1.0))


LOG = [
    "ERROR at 12:30 code=17", "all fine", "12 passed in 3s", "  at f (x.js:1)", "Traceback (most recent call last):", "goroutine 7 [running]:", "warning: slow", "fatal then info", "info before error",
    "=== 3 failed ===", "Total: 4", "summary of it", "   3: 0x1f", "  --> src/a.rs", "... 4 more", "  ... 4 more", "errors abound", "trace of it", "debugging", "", "=", "k=1:2 at 33", "a1 b2", "Results", "10 tests", '  File "a.py", line 3', "CRITICAL: x", "test failed 9",
]


def test_line_rules_as_columns(spark):
    from tallyarc.functions import loglines as L

    df = spark.createDataFrame([(x,) for x in LOG], "line string")
    line = F.col("line")
    got = {r.line: r for r in df.select("line", L.level(line).alias("level"), L.is_trace(line).alias("trace"), L.is_summary(line).alias("summary"), L.score(line).alias("score"), L.dedupe_key(line).alias("key")).collect()}
    for x in LOG:
        r = got[x]
        assert (r.level, r.trace, r.summary, r.key) == (C.level(x), C.is_trace(x), C.is_summary(x), C.dedupe_key(x)), x
        assert abs(r.score - C.line_score(x)) < 1e-9


def test_simhash_by_its_definition():
    for text in ("", "abc", "abcd", "The quick brown fox jumps over the lazy dog " * 3, "ÄÖÜ äöü ß"):
        low, votes = text.lower(), [0] * 64
        for shingle in [low[i : i + 4] for i in range(len(low) - 3)] or [low]:
            h = 0xCBF29CE484222325
            for b in shingle.encode():
                h = (h ^ b) * 0x100000001B3 % (1 << 64)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        assert C.simhash64(text) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_reducers_keep_what_matters():
    plain = [f"line {i} says nothing" for i in range(200)]
    log = "\n".join([*plain[:60], "ERROR: disk full", *plain[60:120], "test_x failed", *plain[120:], "== 3 failed, 9 passed =="])
    out = C.compress_log(log)
    assert "ERROR: disk full" in out and "test_x failed" in out and "== 3 failed, 9 passed ==" in out and "lines omitted: 1 errors, 2 fails" in out and len(out) < len(log)
    assert C.compress_log("a\nb") == "a\nb" and C.marked_key(out) == C.content_key(log)
    matches = "\n".join([f"src/a.py:{i}:plain {i}" for i in range(1, 30)] + ["src/a.py:30:error here", "src/b.py:1:only", "no match"])
    out = C.compress_matches(matches).split("\n")
    assert "src/a.py:30:error here" in out and "src/a.py:1:plain 1" in out and "[... and 25 more in src/a.py]" in out and len(out) < 12
    hunk = lambda i, mark: f"@@ -{i},9 +{i},9 @@\n" + "\n".join(f" c{k}" for k in range(6)) + f"\n-old {mark}\n+new {mark}\n" + "\n".join(f" d{k}" for k in range(6))
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n" + "\n".join(hunk(i, "security" if i == 7 else str(i)) for i in range(20))
    out = C.compress_diff(diff)
    assert "+new security" in out and "+new 0" in out and "+new 19" in out and "[1 files, +20 -20, 10 hunks omitted]" in out and " c0" not in out.split("\n")
    assert C.adaptive_k(["same"] * 50) == 3 and C.adaptive_k([str(i) for i in range(8)]) == 8
    varied = [f"{chr(97 + i % 26)}{i * 7919} words {i * i} of {i}" for i in range(60)]
    assert 3 <= C.adaptive_k(varied) <= 60


def test_adaptive_k_by_its_branches():
    rising = [f"w{i} x{i}" for i in range(40)]  # every item is new: no bend, all of it is wanted
    assert C.bend(C.novelty(rising)) is None and C.adaptive_k(rising) == 40
    assert C.adaptive_k(rising, most=12) == 12 and C.adaptive_k(rising, bias=0.1) >= 4
    front = [f"alpha{i} beta{i} gamma{i * 7} delta{i * 3}" for i in range(10)] + ["the very same words again"] * 40
    assert C.bend(C.novelty(front)) == 11 and C.clusters(front) / 50 <= 0.7
    assert C.adaptive_k(front) in (11, 13)  # a fifth more where the part compresses unlike the whole
    assert C.novelty(["one", "one", "", "two words", "two words"]) == [1, 1, 2, 3, 3]
    assert C.bend([5, 5, 5]) == 1

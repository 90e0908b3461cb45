import hashlib
import re

from tallyarc.llm import fingerprints as P


def plain_fingerprint(text):
    """The SimHash bit by bit, in plain integers."""
    import math

    full = (1 << 64) - 1
    a, b, c = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def mix(x):
        x = (x ^ x >> 30) * b & full
        x = (x ^ x >> 27) * c & full
        return x ^ x >> 31

    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)
    words = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in re.findall(r"[^\x20\x09-\x0D]+", low)]
    count = {}
    for term in words + [mix((x * a + y) & full) for x, y in zip(words, words[1:], strict=False)]:
        count[term] = count.get(term, 0) + 1
    votes = [0.0] * 256
    for term, n in count.items():
        for lane in range(4):
            data = mix((term + (lane * a + c)) & full).to_bytes(8, "little")
            for k in range(64):
                votes[64 * lane + k] += (1 + math.log(n)) * (1 if data[k // 8] >> (7 - k % 8) & 1 else -1)
    return bytes(sum((votes[8 * i + k] > 0) << (7 - k) for k in range(8)) for i in range(32))


def test_fingerprint_by_its_definition(rows):
    for text in ["", "one", "One one", "A b c d e f g h i j k", "é É \u212a k", *(t for _, t, _ in rows[:25] if t)]:
        got, want = (int.from_bytes(x, "big") for x in (P.fingerprint(text), plain_fingerprint(text)))
        assert (got ^ want).bit_count() <= 1  # votes that are equal but for rounding


def test_edited_rows(spark, rows):
    once = sorted({(i, t or "") for i, t, _ in rows if i is not None}, reverse=True)
    df = spark.createDataFrame(once, "doc_id long, text string").repartition(3)
    for size in (7, 10_000):
        got = {r.doc_id: r for r in P.edited_fingerprints(df, size).collect()}
        for k, (i, t) in enumerate(once):
            changed = P.edited(t, once[(k + 1) % len(once)][1])
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
            assert r.fingerprint == P.fingerprint(t).hex() and r.edited_fingerprint == P.fingerprint(changed).hex()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(got) == len(once)


def test_rows_with_nulls_and_repeats(docs, rows, nothing):
    assert P.edited_fingerprints(docs, 9).count() == len(rows)
    assert P.edited_fingerprints(nothing).count() == 0


def test_one_row(spark):
    row = P.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0


def test_near_fingerprints(spark, rows):
    fps = sorted({P.fingerprint(t) for _, t, _ in rows})
    near = P.near_fingerprints(spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary"), radius=20)
    got = {(bytes(r.a), bytes(r.b)): r.distance for r in near.collect()}
    dist = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    assert got == {(a, b): dist(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if dist(a, b) <= 20}


def test_likeness_follows_what_texts_share():
    a = " ".join(f"w{i}" for i in range(400))
    half = " ".join(f"w{i}" if i < 200 else f"x{i}" for i in range(400))
    other = " ".join(f"y{i}" for i in range(400))
    f = P.fingerprint
    assert P.likeness(f(a), f(a)) == 1.0
    assert 0.3 < P.likeness(f(a), f(half)) < 0.7 and P.likeness(f(a), f(other)) < 0.3


def test_query_equals_plain_python(spark, tmp_path):
    import math
    import random

    from tallyarc.llm import queries

    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    base = [r.choice(words) for _ in range(400)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 400, 10)] + [" ".join(base)] * 3 + ["", None, "ab", "Ünïcode 😀 text"]
    rows = list(enumerate(texts))
    spark.createDataFrame([(*x, "f", 1) for x in rows], "doc_id long, text string, fingerprint string, n_near int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.QUERIES["op8_simhash"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    value = {i: int.from_bytes(plain_fingerprint(t or ""), "big") for i, t in rows}
    like = lambda a, b: 1.0 if a == b else max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 256))
    for i, t in rows:
        t, after = t or "", rows[i - 1][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(x.near_next - like(value[i], value[rows[i - 1][0]])) < 0.02
        assert abs(x.near_edited - like(value[i], int.from_bytes(plain_fingerprint(changed), "big"))) < 0.02
        own = {int(y.fingerprint, 16) for y in got.values()}
        assert x.n_near == (None if i % 20 else sum(0 < (f ^ int(x.fingerprint, 16)).bit_count() <= 3 for f in own))
    assert got[0].n_near > 0


def test_near_in_two_radii(spark):
    import random

    r = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(256), n))
    bases = [r.getrandbits(256) for _ in range(8)] + [(1 << 255) | 1, (1 << 256) - 1]
    own = dict(enumerate([*bases, 0, *(flip(b, n) for b in bases for n in (1, 3, 4, 8, 12, 15, 16, 17, 20)), bases[0]]))
    df = spark.createDataFrame([(i, f"{x:064x}") for i, x in own.items()], "doc_id long, fingerprint string").repartition(3)
    got = {x.doc_id: x for x in P.with_near(df, 3, 16, 2).collect()}
    assert len(got) == len(own)
    for i, x in own.items():
        near = [(x ^ y).bit_count() for y in set(own.values()) - {x}]
        assert (got[i].n_near, got[i].n_near_16) == ((None, None) if i % 2 else (sum(d <= 3 for d in near), sum(d <= 16 for d in near)))
    assert got[0].n_near_16 > got[0].n_near > 0
    for radius, blocks in ((0, None), (1, 3), (2, 4)):
        fps = spark.createDataFrame([(bytearray(x.to_bytes(32, "big")),) for x in own.values()], "fp binary")
        found = {(bytes(x.a), bytes(x.b)): x.distance for x in P.near_fingerprints(fps, radius, blocks).collect()}
        every = sorted({x.to_bytes(32, "big") for x in own.values()})
        dist = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
        assert found == {(a, b): dist(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if dist(a, b) <= radius}

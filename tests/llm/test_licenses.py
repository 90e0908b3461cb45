import re

from tallyarc.llm import licenses as L


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(L.WORD, low)
    hits = [(p, label) for label, phrase in L.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    return len(w), len(hits), min((p for p, _ in hits), default=None), max((p for p, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "Released under the MIT License.", "released UNDER, the; mit-license under the mit license", "under the the mit license", "Apache License, Version 2.0; cc by nc 4.0 CC-BY-NC",
    "permission is hereby granted free of charge to any person obtaining a copy of that software and associated documentation files", "This work is licensed under the GNU General Public License, version 3.", "", None, "été under the mit license à",
    " ".join(["under the mit license"] * 300), "by nc cc", "x" * 100_000,
]


def test_base_equals_brute_force(spark, docs, rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert L.license_scan(docs).count() == len(rows)


def test_method_labels(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.license_scan(df).collect()}
    assert got[4][0] == "mit" and 0.75 <= got[4][1] < 1
    assert got[5] == ("gpl-3", 1.0)
    assert got[6] == ("", 0.0) == got[7]


def test_empty_and_native(nothing):
    out = L.license_scan(nothing)
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def brute_labels(text):
    """Diagonal voting in plain Python: labels and score."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, g = re.findall(L.WORD, low), L.GRAM
    spans = []  # label, base, exact, start, words, size, cover
    for t, (label, phrase) in enumerate(L.BASE + L.STATEMENTS):
        p, by = phrase.split(), {}
        for pos in range(len(w) - g + 1):
            for at in range(len(p) - g + 1):
                if w[pos : pos + g] == p[at : at + g]:
                    by.setdefault(pos - at, []).append((at, pos))
        groups, last = [], None
        for d in sorted(by):
            if t < len(L.BASE) or last is None or d - last > L.NEAR:
                groups.append([])
            groups[-1].append(by[d])
            last = d
        for own in groups:
            hits = [x for diagonal in own for x in diagonal]
            lo, hi = min(pos for _, pos in hits), max(pos for _, pos in hits)
            cover = min(1.0, len({a + k for a, _ in hits for k in range(g)}) / len(p))
            spans.append((label, t < len(L.BASE), max(map(len, own)) == len(p) - g + 1, lo, hi - lo + g, len(p), cover))
    most = {}
    for s in spans:
        if not s[1]:
            most[s[3]] = max(most.get(s[3], 0), s[6])
    held = [s for s in spans if (s[1] and s[2]) or (not s[1] and s[6] >= L.COVER and s[6] == most[s[3]] and s[4] <= s[5] * L.STRETCH)]
    return ",".join(sorted({s[0] for s in held})), max([s[6] for s in spans if not s[1] or s in held], default=0.0)


def test_labels_and_score_equal_brute_force(spark, sf_dir):
    import random

    from tallyarc.llm.common import table

    r, statements = random.Random(4), [p.split() for _, p in L.STATEMENTS]
    texts = [t for t in TEXTS if len(t or "") < 10_000] + ["this wor\u212a is free", "L\u0130CENSE under the mit license", "UNDER THE MIT L\u0130CENSE"]
    for _ in range(60):
        words = list(r.choice(statements))
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = r.choice([[], ["extra"], ["two", "more"]])
        texts.append(" ".join(["before"] * r.randint(0, 3) + words + r.choice(statements)[: r.randint(0, 8)]))
    texts += [x.text for x in table(spark, sf_dir, "documents").select("text").collect() if "licen" in (x.text or "").lower()][:60]
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (a, round(b, 9)) for i, (a, b) in enumerate(map(brute_labels, texts))}

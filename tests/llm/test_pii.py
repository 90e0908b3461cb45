import re

from pyspark.sql import functions as F

from tallyarc.llm import pii as P


def luhn(s):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in re.finditer(rx, text or "") if ok(m.group())]
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found))


TEXTS = [
    "mail a.b@c.d.e_f@g.hi, x@y @z.w", "a@b.c@d.e", "a@@b.c", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1, 001.02.3.255 9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 0000 0000 0000",
    "call +1 (437) 555-0689 or +12345, +1 234 567 890 123 456", "é 😀 +44 20 7946 0958 x@é.com 😀 me@mail.org", "", None, "1" * 5000, "a" * 20_000 + "@", "." * 20_000 + "@x." + "a." * 3000, "+1" + " " * 5000, "+" * 5000 + "9",
]


def test_base_equals_brute_force(spark, docs, rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = P.pii_spans(df).select("doc_id", F.expr(P.spans_text("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in out} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert P.pii_spans(docs).count() == len(rows)


def test_discovers_by_context(spark):
    seen = [(i, f"please write to me{i}@mail.org for news") for i in range(12)]
    df = spark.createDataFrame([*seen, (99, "please write to me99@mailhost for news"), (100, "the year 1999 was")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in P.pii_spans(df).select("doc_id", F.expr(P.spans_text("spans")).alias("s")).collect()}
    assert got[3] == "email:16:28" and got[100] == ""


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é me@mail.org, +1 (437) 555-0689.", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, spans long")
    got = {r.doc_id: (r.text, r.spans) for r in P.redact(df).collect()}
    assert got == {1: ("é [EMAIL], [PHONE].", 7), 2: (None, 8), 3: ("clean", 9)}


def test_empty_and_native(nothing):
    out = P.pii_spans(nothing)
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def test_discovers_tokens_of_other_shapes(spark):
    say = "please write to {} for news", "call {} tonight"
    seen = [(i, say[0].format(f"me{i}@mail.org")) for i in range(30)] + [(50 + i, say[1].format(f"+1 (437) 555-06{i + 10}")) for i in range(30)]
    new = [say[0].format("me99@mailhost"), say[0].format('("me99@mailhost")'), say[0].format("me99(at)mailhost"), say[1].format("4375550689"), "the year 1999 was"]
    df = spark.createDataFrame([*seen, *((100 + i, t) for i, t in enumerate(new))], "doc_id long, text string")
    got = {r.doc_id: r.s for r in P.pii_spans(df).select("doc_id", F.expr(P.spans_text("spans")).alias("s")).collect()}
    assert [got[100 + i] for i in range(5)] == ["email:16:29", "email:18:31", "email:16:32", "phone:5:15", ""]


def test_discovers_the_unseen_of_few(spark):
    rows = [*((i, f"please write to me{i}@mail.org for news") for i in range(12)), (99, "please write to me99@mailhost for news"), (100, "the year 1999 was")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in P.pii_spans(df).select("doc_id", F.expr(P.spans_text("spans")).alias("s")).collect()}
    assert got[99] == "email:16:29" and got[100] == ""


def brute_discovered(texts):
    """The graph of patterns and instances scored in plain Python: ``{(text number, start, end): kind number}``."""
    rows = []
    for n, text in enumerate(texts):
        seeds = sorted((m.start(), m.end(), k) for k, (_, rx, ok) in enumerate(RULES) for m in re.finditer(rx, text) if ok(m.group()))
        tokens = [(a, b, k) for a, b, k in seeds]
        for m in re.finditer(P.TOKEN.replace("*+", "*"), text):
            head, tail = re.search(P.HEAD, m.group()), re.search(P.TAIL, m.group())
            a, b = m.start() + (len(head.group()) if head else 0), m.end() - (len(tail.group()) if tail else 0)
            if a < b and not any(s < b and a < e for s, e, _ in seeds):
                tokens.append((a, b, None))
        for a, b, k in tokens:
            left, right = text[max(a - P.AROUND, 0) : a].lower(), text[b : b + P.AROUND].lower()
            part = lambda rx, side: (lambda x: re.sub("[0-9]", "0", x.group(1)) if x else "")(re.search(rx, side))
            one, two = part(r"([^\W_]+)[\W_]*$", left), part(r"^[\W_]*([^\W_]+)", right)
            named = {"L": one, "R": two, "B": f"{one} {two}" if one and two else "", "LL": part(r"([^\W_]+[\W_]+[^\W_]+)[\W_]*$", left), "RR": part(r"^[\W_]*([^\W_]+[\W_]+[^\W_]+)", right), "K": part(r"([\w-]+)\s*[=:]+[\s(\x22\x27]*$", left)}
            own = text[a:b]
            made = "at" if "@" in own else "mixed" if re.search(r"[^\W\d_]", own) else "dots" if re.search(r"[0-9]\.[0-9]", own) else "digits"
            for name, of in named.items():
                if of:
                    rows.append((n, a, b, k, made, f"{name} {of}", own.lower()))
    score = {(n, a, b): float(k is not None) for n, a, b, k, *_ in rows}
    for _ in range(P.ROUNDS):
        patterns = {}
        for name in {r[5] for r in rows}:
            own = {}
            for r in rows:
                if r[5] == name:
                    s, k = own.get(r[6], (0.0, None))
                    own[r[6]] = max(s, score[r[:3]]), r[3] if k is None else k if r[3] is None else min(k, r[3])
            counts = [sum(k == i for _, k in own.values()) for i in range(4)]
            if max(counts) >= P.SEEDS:
                trust = sum(s for s, _ in own.values()) / (len(own) + 1) * max(counts) / sum(counts)
                patterns[name] = trust, counts.index(max(counts))
        best = {}
        for n, a, b, k, made, name, _ in rows:
            if k is None and name in patterns:
                trust, kind = patterns[name]
                best[n, a, b] = max(best.get((n, a, b), (-1, 0)), (trust * (1 if made == P.MADE[kind] else P.OTHERWISE), -kind))
        score |= {key: trust for key, (trust, _) in best.items()}
    return {key: -kind for key, (trust, kind) in best.items() if trust >= P.TRUST}


def test_discovery_equals_brute_force(spark):
    import random

    r = random.Random(8)
    frames = ["please write to {} for news", "call {} tonight", "from host {} at night", "paid by {} today", "see {} or {}"]
    values = [lambda: f"u{r.randint(0, 99)}@mail.org", lambda: f"+1 437 555 0{r.randint(100, 999)}", lambda: ".".join(str(r.randint(1, 250)) for _ in range(4)), lambda: "4111 1111 1111 1111", lambda: str(r.randint(10, 10**9)), lambda: f"x{r.randint(0, 9)}@host", lambda: f'"k-{r.randint(0, 99)}",']
    texts = []
    for _ in range(300):
        k = r.randrange(5)
        main = values[k] if k < 4 and r.random() < 0.93 else r.choice(values)
        texts.append(frames[k].format(*(main() for _ in range(frames[k].count("{}")))))
    want = brute_discovered(texts)
    got = {}
    for row in P.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        base = {(x.start, x.k, x.end) for x in row.base}
        got |= {(row.doc_id, x.start, x.end): x.k for x in row.spans if (x.start, x.k, x.end) not in base}
    assert got == want and len(want) > 3


def test_copies_of_a_text_are_one_seed(spark):
    rows = [*((i, "please write to me@mail.org for news") for i in range(12)), (99, "please write to me99@mailhost for news")]
    got = {r.doc_id: r.s for r in P.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.expr(P.spans_text("spans")).alias("s")).collect()}
    assert got[99] == "" and got[0] == "email:16:27"


def test_unseen_identifiers_planted_in_the_given_texts(spark, sf_dir):
    """Precision and recall of what patterns find beyond the seeds; no seed is lost and clean texts stay clean."""
    import random

    r = random.Random(6)
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    frames = [(0, "contact: {}", lambda i: f"ann{i}@mail.org", lambda i: f"ann{i}@intranet"), (0, "reachable under {} daily", lambda i: f"bob{i}@post.net", lambda i: f"bob{i}[at]post"),
              (3, "direct dial {}", lambda i: f"+49 30 555 {1000 + i}", lambda i: f"0305551{100 + i}"), (1, "host_addr={}", lambda i: f"10.0.{i}.7", lambda i: f"10.0.{i}.x7")]
    planted, rows = set(), []
    for n, (i, text) in enumerate(docs):
        kind, frame, seen, new = frames[n % 4]
        hidden = n % 5 == 4
        value = (new if hidden else seen)(n)
        words = (text or "").split(" ")
        at = r.randrange(len(words) + 1)
        before = " ".join(words[:at])
        lead = (before + " " if before else "") + frame.split("{}")[0]
        rows.append((i, f"{lead}{value}{frame.split('{}')[1]} " + " ".join(words[at:])))
        if hidden:
            planted.add((i, len(lead), kind, len(lead) + len(value)))
    found, lost = set(), 0
    for x in P.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base, spans = ({(y.start, y.k, y.end) for y in s} for s in (x.base, x.spans))
        lost += len(base - spans)
        found |= {(x.doc_id, *y) for y in spans - base}
    assert lost == 0 and len(planted) >= 30
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)

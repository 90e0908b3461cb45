"""Operators on small tables: ties, blanks, ranges and errors."""

import pytest
from pyspark.sql import functions as F

from tallyarc.operators import archive as A
from tallyarc.operators import board as B
from tallyarc.operators import graph as G
from tallyarc.operators import hints as H
from tallyarc.operators import search as S
from tallyarc.operators import similarity as D
from tallyarc.operators import telemetry as U
from tallyarc.operators import vectors as V
from tallyarc.sources import snapshot as N


def test_spec_fold(spark):
    notes = [
        (1, "p", "T-1", "[spec] subject: a; priority: P1; epic: E"), (2, "p", "T-1", "[spec] files: a.go, b.go"), (3, "p", "T-1", "[spec] depends_on: t-2, T-3"),
        (4, "p", "T-1", "[spec] acceptance: free text, with commas"), (5, "p", "T-1", "[spec-replace] files: "), (6, "p", "T-1", "[spec] files: [c.go]"),
        (7, "p", "T-1", "[spec] subject: b"), (8, "p", "T-1", "plain note"), (9, "p", "T-2", "[spec] subject: only"),
    ]
    df = spark.createDataFrame(notes, "id long, project_id string, task_id string, note string")
    one = {r.task_id: r for r in B.spec_fold(df).collect()}
    assert (one["T-1"].subject, one["T-1"].priority, one["T-1"].files) == ("b", "P1", ["c.go"])
    assert one["T-1"].depends_on == ["T-2", "T-3"] and one["T-1"].acceptance == ["free text, with commas"]
    assert one["T-2"].files == []


def test_cascade(spark):
    status = spark.createDataFrame([("p", "A", "done"), ("p", "B", "blocked"), ("p", "C", "blocked"), ("p", "D", "blocked")], "project_id string, task_id string, status string")
    specs = spark.createDataFrame([("p", "B", ["A"]), ("p", "C", ["A", "X"]), ("p", "D", [])], "project_id string, task_id string, depends_on array<string>")
    assert [r.task_id for r in B.cascade(specs, status).collect()] == ["B"]
    done = {r.task_id: r.all_done for r in B.deps_all_done(specs, status).collect()}
    assert done == {"B": True, "C": False, "D": True}


def test_first_claim(spark):
    claims = spark.createDataFrame([("p", "A", "x", 2, 1), ("p", "A", "y", 1, 9), ("p", "A", "z", 1, 8)], "project_id string, task_id string, agent_id string, created_at long, id long")
    row = B.first_claim_wins(claims).first()
    assert (row.owner, row.claims) == ("z", 3)


def test_ripples(spark):
    links = spark.createDataFrame([(1, 2, "informs"), (2, 3, "informs"), (3, 1, "informs"), (1, 3, "contradicts")], "from_id long, to_id long, relation string")
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert {(r.id, r.distance) for r in G.ripples(links, seeds, 5).collect()} == {(2, 1), (3, 1)}
    assert {(r.id, r.distance) for r in G.ripples(links, seeds, 5, relation="informs").collect()} == {(2, 1), (3, 2)}
    assert G.ripples(links, seeds, 0).count() == 0
    assert G.cycles(links, seeds, 3).first().cycles == 1
    with pytest.raises(ValueError):
        G.ripples(links, seeds, 11)


def test_quantize(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 0.5]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, -3.0])], "id long, v array<double>")
    got = {r.id: r.q for r in df.select("id", V.quantize(F.col("v")).alias("q")).collect()}
    assert got == {1: [127, -127, 64], 2: None, 3: None, 4: None, 5: [127, -128]}


def test_title_boost(spark):
    df = spark.createDataFrame([("A  Title", "a title"), ("A long title here", "title long"), ("x", ""), ("", "y")], "t string, q string")
    assert [r[0] for r in df.select(S.title_boost(F.col("t"), F.col("q"))).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_bm25_prefix_and_clamp(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet"), (3, "gamma"), (4, "delta words"), (5, "other words")], "id long, text string")
    found, sizes = S.postings(docs, ["text"])
    hits = S.bm25(found, sizes, spark.createDataFrame([(1, "alpha")], "qid int, token string"))
    assert {r.id for r in hits.collect()} == {1, 2} and all(r.score < 0 for r in hits.collect())


def test_near_pairs_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(3)
    rows = [(i, r.sample("abcdefghijkl", r.randint(1, 8))) for i in range(60)]
    got = {(x.left_id, x.right_id) for x in D.near_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.6).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    assert got == want


def test_link_rules(spark):
    entries = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(1, 2, "informs")], "from_id long, to_id long, relation string")
    new = spark.createDataFrame([(1, 2, "supersedes"), (2, 1, None), (2, 2, "informs"), (1, 9, "informs")], "from_id long, to_id long, relation string")
    assert {tuple(r) for r in A.link(links, entries, new).collect()} == {(1, 2, "informs"), (2, 1, "informs")}
    with pytest.raises(ValueError):
        A.reforge(entries.withColumn("status", F.lit("current")), links, spark.createDataFrame([(1, 1)], "old_id long, new_id long"))


def test_usage_lines(spark):
    lines = spark.createDataFrame([("2024-01-01T00:00:00Z\tp\tt\t0\t5\t40",), ("2024-01-01T00:00:00Z\tp\tt\t0\t5",), ("",), ("never\tp\tt\t0\t5",), ("a\tb",)], "value string")
    assert sorted(r.resp_bytes for r in U.parse_usage(lines).collect()) == [0, 40]


def test_redact(spark):
    df = spark.createDataFrame([("key sk-abcdefghijklmnop1 at /home/me/x",)], "t string")
    assert df.select(U.redact(F.col("t"))).first()[0] == "key [redacted] at ~/x"


def test_hint_session():
    s = H.Session()
    assert s.call(1, "lore_inscribe", "todo: fix")[0] == "inscribe-looks-like-quest"
    assert s.call(2, "lore_inscribe", "todo: fix")[0] == "no-session-start"
    rule, decided = s.call(3, "quest_post", "")
    assert rule is None and decided == [(1, "inscribe-looks-like-quest", 1, 2)]
    s.call(4, "session_start", "")
    assert s.call(5, "quest_journal", "QUEST-4")[0] == "journal-outside-accepted"
    assert s.call(6, "quest_accept", "quest-5") == (None, [(5, "journal-outside-accepted", 1, 1)])
    assert s.call(7, "quest_journal", "QUEST-5")[0] is None
    fresh = H.Session(s.dump())
    assert fresh.call(8, "quest_clear", "short", brief_stale=True)[0] == "no-brief-24h"
    late = H.Session()
    late.call(0, "session_start", "")
    fired = [late.call(i, "lore_study", "")[0] for i in range(1, 60)]
    assert fired.index("session-end-without-brief") == 28 and fired.count("session-end-without-brief") == 4


def test_restore(spark):
    entries = spark.createDataFrame([(1, "p", "t", "idea", "A", "s", "", "seed"), (2, "p", "t", "idea", "B", "s", "", "seed")], N.ENTRY)
    links = spark.createDataFrame([(1, 2, "")], N.LINK)
    docs = spark.createDataFrame([("p", '{"schema_version":1,"lore":[{"id":1,"topic":"t","kind":"idea","title":"A","summary":"s","tags":"","status":"seed"},{"id":2,"topic":"t","kind":"idea","title":"B","summary":"s","tags":"","status":"seed"}],"links":[{"from_id":1,"to_id":2,"relation":""}]}')], "project_id string, document string")
    added, found = N.restore(N.read_documents(docs), entries.where("id = 2"))
    assert [(r.id, r.title) for r in added.collect()] == [(3, "A")]
    assert [tuple(r) for r in found.collect()] == [(3, 2, "informs")]
    with pytest.raises(ValueError):
        N.read_documents(docs.withColumn("document", F.regexp_replace("document", '"schema_version":1', '"schema_version":9')))


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "adr").mkdir()
    (tmp_path / "adr" / "use-spark_now.md").write_text("---\nx: 1\n---\n# Title\n\nShort.\n\nA second line that goes on.\n")
    files = N.read_markdown(spark, str(tmp_path))
    none = spark.createDataFrame([], "project_id string, file_path string")
    row = N.catalog(files, none, "p").first()
    assert (row.title, row.kind, row.summary, row.status) == ("Use Spark Now", "decision", "Short. A second line that goes on.", "imported")


def test_empty_tables(spark):
    entries = spark.createDataFrame([], "id long, project_id string, kind string, status string, title string, summary string, created_at timestamp_ntz, access_count long")
    assert A.dossier(entries).count() == A.inquest(entries).count() == D.exact_pairs(entries).count() == 0


def test_declared_tables(spark, tmp_path):
    from tallyarc import schemas

    notes = spark.createDataFrame([(1, "p", "T-1", "[spec] subject: a"), (2, "q", "T-2", "x")], "id long, project_id string, task_id string, note string")
    for _ in range(2):
        schemas.append(notes, str(tmp_path), "task_notes")
    back = schemas.read(spark, str(tmp_path), "task_notes")
    assert back.where("project_id = 'p'").count() == 2 and back.where("agent_id IS NULL").count() == 4
    for name, ddl in schemas.TABLES.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_running_numbers_and_sums(spark):
    import random

    from tallyarc.functions.numbering import running

    rows = [(i, i * 7919 % 101, i % 5) for i in range(300)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k long, w long")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.id: r.n for r in running(df, [F.col("k"), F.col("id")], "n").collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    sums = {r.id: r.n for r in running(df, [F.col("k"), F.col("id")], "n", F.col("w")).collect()}
    assert sums == {r[0]: sum(x[2] for x in order[: i + 1]) for i, r in enumerate(order)}
    assert running(df.limit(0), [F.col("id")], "n").count() == 0


def test_top_dot_equals_brute_force(spark):
    import random

    r = random.Random(2)
    vectors = [(i, [r.randint(-3, 3) for _ in range(4)]) for i in range(200)] + [(900, None), (901, [1, 2])]
    queries = [(1, [1, 2, 3, 4]), (2, [0, 0, 0, 1]), (3, None), (4, [1, -1])]
    df = spark.createDataFrame(vectors, "id long, q array<tinyint>").repartition(5)
    got = {(x.qid, x["rank"]): (x.id, x.dot) for x in V.top_dot(df, spark.createDataFrame(queries, "qid int, qv array<tinyint>"), 7).collect()}
    want = {}
    for qid, qv in queries:
        if qv is not None:
            scored = sorted((-sum(a * b for a, b in zip(v, qv, strict=True)), i) for i, v in vectors if v is not None and len(v) == len(qv))
            want |= {(qid, k + 1): (i, -d) for k, (d, i) in enumerate(scored[:7])}
    assert got == want
    with pytest.raises(ValueError):
        V.top_dot(df, spark.createDataFrame(queries, "qid int, qv array<tinyint>"), 7, most=2)


def test_embed_deterministic(spark):
    import hashlib
    import math
    import struct

    texts = ["a", "", "some longer text", "é"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.embed_deterministic("t").alias("e")).collect()]
    for text, e in zip(texts, got, strict=True):
        tile = [x if math.isfinite(x) else 0.0 for x in struct.unpack("<16f", hashlib.sha512(text.encode()).digest())]
        norm = math.sqrt(24 * sum(x * x for x in tile))
        assert len(e) == 384 and all(abs(a - b / norm) < 1e-6 for a, b in zip(e, tile * 24, strict=True))


def test_plans_of_steps_cycles_and_widths(spark):
    from tallyarc.operators import upkeep as K

    steps = [("a", 1, 4, False), ("a", 2, 4, True), ("a", 3, 4, False), ("a", 4, 4, False), ("b", 1, 99, False), ("b", 2, 0, False)]
    got = {(r.run, r.place): r.outcome for r in K.plan_steps(spark.createDataFrame(steps, "run string, place long, seconds long, fails boolean"), 10).collect()}
    assert got == {("a", 1): "done", ("a", 2): "error", ("a", 3): "done", ("a", 4): "skipped", ("b", 1): "done", ("b", 2): "skipped"}
    corpora = spark.createDataFrame([("x", 100, 100, 40), ("y", 100, 5, 40), ("z", 100, 100, 1), ("n", 100, 100, 0)], "corpus string, eligible long, pending long, per_cycle long")
    got = sorted((r.corpus, r.cycle, r.done) for r in K.backfill_cycles(corpora).collect())
    assert got == [("x", 1, 40), ("x", 2, 40), ("x", 3, 20), *(("z", k, 1) for k in range(1, 6))]
    scored = lambda ok: spark.createDataFrame([(i, i, ok(i)) for i in range(1, 101)], "id long, score long, ok boolean")
    for ok, found, rank, k in ((lambda i: True, 10, 10, 10), (lambda i: i % 3 == 0, 10, 30, 40), (lambda i: i > 97, 3, 100, 160), (lambda i: False, 0, 100, 160)):
        row = K.widened(scored(ok)).first()
        assert (row.found, row["rank"], row.k) == (found, rank, k)
    assert K.split_statements(None) == [] and K.split_statements("SELECT 1") == ["SELECT 1"]


def test_search_helper_and_registered_functions(spark):
    from tallyarc.functions import registry as R
    from tallyarc.functions.compact import simhash64

    corpus = spark.createDataFrame([(1, "alpha beta", "first words", "t"), (2, "other", "alphabet soup", "t"), (3, "none", "nothing at all", "t"), (4, "more", "words", "t"), (5, "yet", "more", "t")], "id long, title string, summary string, tags string")
    assert {r.id for r in R.search("the alpha", corpus).collect()} == {1, 2}
    assert R.register(spark) == sorted(R.FUNCTIONS)
    row = spark.sql("SELECT tokenize('the quick fox') AS t, porter_stem('running') AS p, simhash64('abc') AS s, quantize_int8(array(0.5d, -1d)) AS q").first()
    assert (row.t, row.p, row.s % (1 << 64), row.q) == (["quick", "fox"], "run", simhash64("abc"), [64, -127])


def test_age_in_words(spark):
    from tallyarc.operators.staleness import format_age

    rows = [("2024-01-01 00:00:00", "2024-01-01 00:00:03.9", "3s"), ("2024-01-01 00:00:00", "2024-01-01 00:05:02", "5m2s"), ("2024-01-01 00:00:00", "2024-01-02 01:00:04", "25h0m4s"), ("2024-01-01 01:00:00", "2024-01-01 00:00:00", "0s")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", format_age(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")).alias("got")).collect())


def test_sessions_are_walked_one_by_one(spark):
    import random

    r = random.Random(6)
    tools = ["quest_fulfill", "session_start", "lore_inscribe", "quest_accept", "quest_brief", "quest_journal", "lore_appraise", "quest_update"]
    args = ["fix login-page", "QUEST-12", "we need to tidy this up", "login-redirect", "see ENTRY-4 which shows a long enough sentence here", "plain words", None]
    calls = [(i, f"s{r.randint(0, 7)}", r.randint(0, 50), r.choice(tools), r.choice(args), r.random() < 0.3, r.random() < 0.3) for i in range(600)]
    df = spark.createDataFrame(calls, "id long, session_id string, ts long, tool string, arg string, empty_result boolean, brief_stale boolean")
    want = set()
    for session in {c[1] for c in calls}:
        state, fired, fate = H.Session(), {}, {}
        for c in sorted((c for c in calls if c[1] == session), key=lambda c: (c[2], c[0])):
            rule, decided = state.call(c[0], *c[3:])
            if rule:
                fired[c[0]] = rule
            fate |= {call: (hit, offset) for call, _, hit, offset in decided}
        want |= {(i, session, rule, *fate.get(i, (None, None))) for i, rule in fired.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert {tuple(x) for x in H.evaluate(df.repartition(3)).collect()} == want and len(want) > 50
        assert H.evaluate(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

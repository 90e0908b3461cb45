"""Steps that were left out or done over and over, and work that grew faster than its tables."""

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stems_read_a_text_once(spark, tmp_path):
    """The words of a text are found once, not once a word, and stems add up; documents without words stay."""
    from tallyarc.operators.index import Index

    docs = spark.createDataFrame([(1, "runs running cat", "run cats"), (2, "", None), (-3, None, "zebras")], "id int, title string, summary string")
    index = Index(spark, f"file://{tmp_path}/index")
    got = index._prepared(docs, ["title", "summary"], True)
    assert _plan(got).count("regexp_extract_all") == 1 and "Join" not in _plan(got)
    rows = {r.id: (r.dl, sorted((t.term, t.tf) for t in r.terms)) for r in got.collect()}
    assert rows == {1: (5, [("cat", 2), ("run", 3)]), 2: (0, []), -3: (1, [("zebra", 1)])}
    assert index._prepared(docs.limit(0), ["title", "summary"], True).count() == 0
    found = index.build(docs, ["title", "summary"], stem=True).scores(spark.createDataFrame([(1, "run")], "qid int, token string"))
    assert [r.id for r in found.collect()] == [1]


def test_a_line_is_searched_once_for_its_level(spark):
    """The leftmost word counts, as in the SQL, though another word of its level comes later; one search a line."""
    import duckdb

    from tallyarc.functions import loglines as L
    from tallyarc.plans import compaction as P

    lines = ["fatal: warn then error", "xerror warn_ing INFO", "debug failed", "nothing", "", "trace\r", "warnings warning", "a critical fail"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string")
    got = df.select("i", L.level(F.col("line")).alias("level"), F.round(L.score(F.col("line")), 6).alias("score"))
    assert _plan(df.select(L.score(F.col("line")).alias("s"))).lower().count("critical") == 1 + 1  # in the pattern and in the map
    want = duckdb.sql(f"SELECT {P._LEVEL} FROM (VALUES {', '.join(f'({i}, {x!r})' for i, x in enumerate(lines))}) t(i, line) ORDER BY i").fetchall()
    rows = got.orderBy("i").collect()
    assert [r.level for r in rows] == [x for (x,) in want]
    assert [r.score for r in rows] == [1.0, 0.3, 0.1, 0.1, 0.1, 0.1, 0.6, 1.0]


def test_log_compress_keeps_what_stands_around():
    """The lines around a kept one stay as the adaptive number allows; a bias of 0 made that number the least one at any text."""
    from tallyarc.functions import compact as C

    lines = [f"step {i} {chr(97 + i % 26)}{i * 7919} did {i * 104729 % 9973} of {i * 31} in {i * i}" for i in range(400)]
    for i in range(20, 400, 30):
        lines[i] = f"ERROR: part {i} broke"
    out = C.compress_log("\n".join(lines)).split("\n")
    assert sum(x in out for x in lines if not x.startswith("ERROR")) > 20
    assert len(C.compress_log("\n".join(lines), 0.0).split("\n")) < len(out) < len(lines)


def test_many_vector_queries_go_in_slices(spark):
    """More queries than are sent at a time: as all of them at once."""
    from tallyarc.operators import vectors as V

    df = spark.range(400).select("id", F.expr("transform(sequence(0, 5), i -> cast(pmod(xxhash64(id, i), 255) - 127 as byte))").alias("q"))
    asked = df.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("q").alias("qv"))
    rows = lambda x: sorted(tuple(r) for r in x.select("qid", "id", "dot", "rank").collect())
    assert rows(V.top_dot_of_many(df, asked, 3, most=60)) == rows(V.top_dot(df, asked, 3))


def test_many_searches_read_documents_not_postings(spark, tmp_path, monkeypatch):
    """Nothing is shuffled before the best of each task; rows that wait are cut again and again; equal to the search of each alone."""
    import random

    from tallyarc.operators import index as I

    monkeypatch.setattr(I, "WAITING", 10)
    r = random.Random(4)
    words = "al alpha alps a be beta betamax gamma gamut delta".split()
    docs = spark.createDataFrame([(i, "", " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(-200, 700)], "id long, title string, summary string").repartition(3)
    index = I.Index(spark, f"file://{tmp_path}/index").build(docs, ["title", "summary"])
    asked = [(q, t) for q in range(40) for t in set(r.choices(["a", "al", "alp", "beta", "gam", "de", "zz"], k=r.randint(1, 4)))]
    tokens = spark.createDataFrame(asked, "qid int, token string")
    many = index.top_of_many(tokens, 6)
    assert "postings" not in "".join(many.inputFiles()) and _plan(many).count("MapInArrow") == 1 and "Join" not in _plan(many)
    rows = lambda df: sorted((x.qid, x.id, round(x.score, 9)) for x in df.collect())
    assert rows(many) == rows(index.top(tokens, 6))


def test_title_pairs_has_all_different_titles(spark):
    """A title that has the words of another is a title of its own: its links are there too."""
    from tallyarc.operators import similarity as D

    rows = [(1, "Red fox runs", "current"), (2, "runs red: fox", "current"), (3, "red fox", "current"), (4, "a b", "current"), (5, "a b", "current"), (6, "red fox", "stale"), (7, "red fox", "current"), (0, "runs red: fox", "current")]
    df = spark.createDataFrame(rows, "id long, title string, status string")
    assert sorted(tuple(r) for r in D.title_pairs(df).collect()) == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 0.667), (1, 3, 0.667), (3, 7, 1.0)]


def test_scope_links_equals_all_pairs(spark, monkeypatch):
    """Topics, prompts and tags, none or many of them: each entry's links as a join of all pairs counts them."""
    import random

    from tallyarc.operators import similarity as D

    r = random.Random(6)
    rows = [(i, r.choice("pq"), r.choice(["x", "y", "z", None]), r.choice(["", None, "u", "v", "w"]), r.choice([None, "", ", ,"] + [",".join(r.choices("abcdefghijklmn", k=r.randint(1, 6)))] * 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, project_id string, topic string, prompted_by string, tags string")
    tags = lambda x: {t.strip() for t in (x[4] or "").lower().split(",")} - {""}
    met = lambda a, b: a[1] == b[1] and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]) or tags(a) & tags(b))
    want = {a[0]: (min([b[0] for b in rows if met(a, b)] + [a[0]]), sum(bool(met(a, b)) for b in rows if b[0] != a[0])) for a in rows}
    for most in (10, 3):
        monkeypatch.setattr(D, "SCOPES", most)
        assert {x.id: (x.rep_id, x.n_links) for x in D.scope_links(df).where("scope = 'any'").collect()} == want
    got = D.scope_links(df).where("scope = 'topic' AND id = 0").collect()
    assert [x.n_links for x in got] == ([sum(a[1:3] == rows[0][1:3] for a in rows) - 1] if rows[0][2] else [])


def test_snapshot_parts_are_compressed(spark, tmp_path):
    from tallyarc.sources import snapshot as N

    status = spark.range(30).selectExpr("'p' AS project_id", "concat('QUEST-', id) AS task_id", "'done' AS status", "'a' AS claimed_by", "timestamp_ntz'2024-01-01' AS updated_at")
    N.write_snapshot(f"file://{tmp_path}", {"task_status": status})
    assert all(f.name.endswith(".gz") for f in tmp_path.glob("snapshot-*/task_status/*/part-*"))
    assert N.read_snapshot(spark, f"file://{tmp_path}")["task_status"].count() == 30

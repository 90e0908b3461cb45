"""Streams that are stopped and started: what they give is what one run over everything gives."""

import random

import pytest
from pyspark.sql import functions as F

from tallyarc.operators import hints as H
from tallyarc.streaming import jobs as J
from tallyarc.streaming import rollups as R


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def events(spark, rows):
    return spark.createDataFrame(rows, "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))


def counts(spark, path, unit="hour"):
    return {(str(r.bucket), r.kind): r.n for r in R.snapshot(spark, path, unit).collect()}


def test_rollups_go_on_and_replay(spark, tmp_path):
    path, log, schema = str(tmp_path / "rollups"), tmp_path / "log", "ts timestamp, kind string"
    assert R.watermark(spark, path) is None and counts(spark, path) == {}
    put(events(spark, [("2026-01-01 10:05:00", "a"), ("2026-01-01 12:00:00", " "), ("2026-01-01 10:50:00", "a")]), log)
    stream = lambda: spark.readStream.schema(schema).parquet(str(log))
    run(R.fold(stream(), path, str(tmp_path / "one")))
    first = {("2026-01-01 10:00:00", "a"): 2, ("2026-01-01 12:00:00", "unknown"): 1}
    assert counts(spark, path) == first
    run(R.fold(stream(), path, str(tmp_path / "one")))  # nothing new
    assert counts(spark, path) == first
    put(events(spark, [("2026-01-01 10:10:00", "a"), ("2026-01-02 01:00:00", "b")]), log)  # one is late, and counts
    run(R.fold(stream(), path, str(tmp_path / "one")))
    live = first | {("2026-01-01 10:00:00", "a"): 3, ("2026-01-02 01:00:00", "b"): 1}
    assert counts(spark, path) == live
    put(events(spark, [("2026-01-02 00:30:00", "b"), ("2026-01-02 02:00:00", "b")]), log)
    run(R.fold(stream(), path, str(tmp_path / "two")))  # offsets are lost: only what is beyond the watermark counts
    assert counts(spark, path) == live | {("2026-01-02 02:00:00", "b"): 1}
    put(events(spark, [("2026-01-02 00:40:00", "b"), ("2026-01-02 03:00:00", "b")]), log)
    run(R.fold(stream(), path, str(tmp_path / "two")))  # its floor stays what it was
    assert counts(spark, path)["2026-01-02 03:00:00", "b"] == 1 and ("2026-01-02 00:00:00", "b") not in counts(spark, path)
    assert counts(spark, path, "day")["2026-01-02 00:00:00", "b"] == 3
    assert R.let_go(spark, path, "2026-01-02") == 1 and {k[0][:10] for k in counts(spark, path)} == {"2026-01-02"}
    assert R.watermark(spark, path) == 1767322800000000


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path, log = str(tmp_path / "rollups"), tmp_path / "log"
    put(events(spark, [("2026-01-01 10:05:00", "a")]), log)
    writer = R.fold(spark.readStream.schema("ts timestamp, kind string").parquet(str(log)), path, str(tmp_path / "c"))
    run(writer)
    for commit in (tmp_path / "c" / "commits").glob("*0*"):  # as if the driver had died before the batch was committed
        commit.unlink()
    run(R.fold(spark.readStream.schema("ts timestamp, kind string").parquet(str(log)), path, str(tmp_path / "c")))
    assert counts(spark, path) == {("2026-01-01 10:00:00", "a"): 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_hints_in_any_batches(spark, tmp_path, seed):
    r = random.Random(seed)
    tools = ["session_start", "lore_appraise", "lore_inscribe", "quest_journal", "quest_accept", "quest_fulfill", "quest_brief"]
    rows = [(i, f"s{r.randrange(3)}", f"2026-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", r.choice(tools), r.choice(["we need to x", "login-page-redirect", "see ENTRY-4 which is a long enough sentence"]), r.random() < 0.5, r.random() < 0.5) for i in range(400)]
    schema = "id long, session_id string, ts timestamp, tool string, arg string, empty_result boolean, brief_stale boolean"
    calls = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    own = list(range(400))
    for i in range(0, 400, 40):  # calls come out of order, by less than the delay
        part = own[i : i + 40]
        r.shuffle(part)
        own[i : i + 40] = part
    log, folder, at = tmp_path / "log", str(tmp_path / "job"), 0
    while at < 400:
        to = at + r.randint(20, 90)
        put(calls.where(F.col("id").isin(own[at:to])), log)
        got = J.finish(J.hints(spark.readStream.schema(schema).parquet(str(log))), "append", folder)
        at = to
    mark = 399 - 60  # minutes: the newest call less an hour
    want = {(x.id, x.session_id, x.rule_id) for x in H.evaluate(calls.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect() if x.id < mark}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 10


def test_hints_of_many_sessions_take_few_groups(spark, tmp_path, monkeypatch):
    """Over four days, so that sessions end; a group of state for each session would be 300."""
    r, groups, plain = random.Random(5), spark.sparkContext.accumulator(0), J._hints
    tools = ["session_start", "lore_appraise", "lore_inscribe", "quest_journal", "quest_accept", "quest_fulfill", "quest_brief"]
    rows = [(i, f"s{i // 400}-{r.randrange(75)}", f"2026-01-{1 + i // 400:02d} {i % 400 // 60:02d}:{i % 400 % 60:02d}:00", r.choice(tools), r.choice(["we need to x", "login-page-redirect", None]), r.random() < 0.5, r.random() < 0.5) for i in range(1600)]
    schema = "id long, session_id string, ts timestamp, tool string, arg string, empty_result boolean, brief_stale boolean"
    calls = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))

    def counted(key, batches, state):
        groups.add(1)
        yield from plain(key, batches, state)

    monkeypatch.setattr(J, "_hints", counted)
    monkeypatch.setattr(J, "DEALT", 8, raising=False)
    for part in (calls.where("id < 900"), calls.where("id >= 900")):
        put(part, tmp_path / "log")
        got = J.finish(J.hints(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))), "append", str(tmp_path / "job"))
    want = {(x.id, x.session_id, x.rule_id) for x in H.evaluate(calls.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect() if x.id < 1599 - 60}
    found = [tuple(x) for x in got.collect()]
    assert set(found) == want and len(found) == len(want) > 300
    assert groups.value <= 6 * 8


def test_signals_go_on_from_their_offsets(spark, tmp_path):
    entries = spark.createDataFrame([(1, "p", "a.md", "current"), (2, "p", "b.md", "current")], "id long, project_id string, file_path string, status string")
    schema, log, path = "id long, project_id string, path string, ts timestamp, op string", tmp_path / "log", str(tmp_path / "signals")
    row = lambda i, f: spark.createDataFrame([(i, "p", f, "2026-01-01 00:00:00", "write")], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    for i, f in ((1, "a.md"), (2, "b.md")):
        put(row(i, f), log)
        run(J.signals(spark.readStream.schema(schema).parquet(str(log)), entries, path, str(tmp_path / "offsets")))
    assert sorted(r.entry_id for r in spark.read.parquet(path).collect()) == [1, 2]
    assert len(list((tmp_path / "signals").glob("epoch=*"))) == 2

"""Log files, snapshots, pass logs, gates and index epochs against plain loops and by hand."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyarc.operators import upkeep as K
from tallyarc.operators import vectors as V
from tallyarc.operators.idlegate import decisions
from tallyarc.operators.passlog import OP, PassLog, fold
from tallyarc.sources import snapshot as N


def plain_rotation(sizes, limit):
    files, file, size = [], 0, 0
    for n in sizes:
        if size >= limit:
            file, size = file + 1, 0
        files.append(file)
        size += n
    return files


@pytest.mark.parametrize("seed", [1, 2])
def test_rotation_begins_anew_from_nothing(spark, seed):
    r = random.Random(seed)
    sizes = [40] * 10 if seed == 1 else [r.choice([1, 5, 40, 99, 100, 101, 350]) for _ in range(300)]
    lines = spark.createDataFrame([(3 * i, n) for i, n in enumerate(sizes)], "id long, bytes long").repartition(3)
    got = {x.id: (x.file, x.kept) for x in K.rotate(lines, 100, keep=2).collect()}
    want = plain_rotation(sizes, 100)
    assert [got[3 * i][0] for i in range(len(sizes))] == want
    assert [got[3 * i][1] for i in range(len(sizes))] == [f >= want[-1] - 2 for f in want]
    assert K.rotate(lines.limit(0), 100).count() == 0


ENTRIES = [(1, "p", "t", "idea", "A", "é \n\" s", "a,b", "seed"), (2, "p", "t", "idea", "B", None, None, "seed"), (3, "q/ 1", "t", "idea", "A", "x", "", "current")]


def parts(spark):
    return {
        "lore": spark.createDataFrame(ENTRIES, N.ENTRY),
        "links": spark.createDataFrame([("p", 1, 2, ""), ("p", 2, 1, "informs")], N.PARTS["links"][0]),
        "task_status": spark.sql("SELECT 'p' AS project_id, concat('T', id) AS task_id, 'next' AS status, cast(NULL AS string) AS claimed_by, timestamp_ntz'2026-01-01 10:00:00.5' AS updated_at FROM range(25)"),
        "task_notes": spark.sql("SELECT id + 1 AS id, 'p' AS project_id, concat('T', id % 25) AS task_id, 'a' AS agent_id, concat('note ', id) AS note, timestamp_ntz'2026-01-01' AS created_at FROM range(60)"),
        "task_events": spark.sql("SELECT id + 1 AS id, 'p' AS project_id, concat('T', id % 25) AS task_id, 'done' AS event, 'a' AS agent_id, timestamp_ntz'2026-01-01' AS created_at FROM range(40)"),
    }


def test_snapshot_round_trip_in_parts(spark, tmp_path):
    path, given = str(tmp_path), parts(spark)
    N.write_snapshot(path, given, part_rows=7)
    back = N.read_snapshot(spark, path)
    for name, df in given.items():
        assert sorted(map(tuple, back[name].collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files = [f for f in (tmp_path / "snapshot-000001" / "task_notes").rglob("part-*")]
    assert len(files) >= 60 / 7 and not list(tmp_path.glob(".writing-*"))
    N.write_snapshot(path, {"lore": given["lore"].limit(1)})
    assert N.read_snapshot(spark, path)["lore"].count() == 1 and (tmp_path / "snapshot-000002").exists()


def test_snapshot_that_is_not_whole(spark, tmp_path):
    N.write_snapshot(str(tmp_path), parts(spark), part_rows=7)
    next((tmp_path / "snapshot-000001" / "task_notes").rglob("part-*")).unlink()
    with pytest.raises(N.SnapshotError):
        N.read_snapshot(spark, str(tmp_path))
    with pytest.raises(N.SnapshotError):
        N.read_snapshot(spark, str(tmp_path / "nowhere"))
    manifest = next((tmp_path / "snapshot-000001" / "manifest").glob("part-*"))
    for crc in manifest.parent.glob(".*crc"):
        crc.unlink()
    manifest.write_text(manifest.read_text().replace('"schema_version":1', '"schema_version":9'))
    with pytest.raises(N.SnapshotError):
        N.read_snapshot(spark, str(tmp_path), check=False)


def test_board_is_put_back_with_new_ids(spark, tmp_path):
    given = parts(spark)
    N.write_snapshot(str(tmp_path), given)
    back = N.read_snapshot(spark, str(tmp_path))
    there = given["task_status"].where("task_id < 'T2'").withColumn("status", F.lit("done")), given["task_notes"].where("id <= 5"), given["task_events"].where("id = 3")
    status, notes, events = N.restore_board(back, *there)
    assert {r.task_id: r.status for r in status.collect()} == {f"T{i}": "done" if f"T{i}" < "T2" else "next" for i in range(25)}
    got = sorted(r.id for r in notes.collect())
    assert got == [*range(1, 6), *range(6, 66)] and events.agg(F.min("id"), F.max("id"), F.count("*")).first()[0:3] == (3, 43, 41)
    assert [r.note for r in notes.where("id > 5").orderBy("id").limit(3).collect()] == ["note 0", "note 1", "note 2"]


def test_bytes_are_cut_between_characters(spark):
    rows = [("abc",), ("éééé",), ("日本語",), ("",), (None,), ("a���",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(N.cut_bytes(F.col("t"), 5)).collect()]
    assert got[:5] == ["abc", "éé", "日", "", None]


def test_gate_gives_the_first_reason(spark):
    hour = lambda h: f"2026-01-01 {h:02d}:00:00"
    rows = [
        ("off", hour(9), 1, "tick", False), ("new", hour(1), 2, "tick", True), ("idle", hour(0), 3, "touch", True), ("idle", hour(1), 4, "tick", True), ("idle", hour(2), 5, "tick", True),
        ("run", hour(0), 6, "touch", True), ("run", hour(3), 7, "begin", True), ("run", hour(9), 8, "tick", True), ("run", hour(10), 9, "end", True), ("run", hour(11), 10, "tick", True), ("run", hour(12), 11, "tick", True), ("run", hour(13), 12, "touch", True), ("run", hour(14), 13, "tick", True),
    ]
    log = spark.createDataFrame(rows, "key string, ts string, id long, what string, armed boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.id: (r.reason, r.allow) for r in decisions(log, 2 * 3600).collect()}
    want = {1: "disabled", 2: "not_idle", 4: "not_idle", 5: "fire", 8: "pass_in_flight", 10: "gap_not_elapsed", 11: "fire", 13: "not_idle"}
    assert got == {i: (w, w == "fire") for i, w in want.items()}
    assert {r.reason for r in decisions(log, 0).collect()} == {"disabled"}


def test_pass_log_is_told_once(spark, tmp_path):
    log = PassLog(spark, str(tmp_path))
    assert log.untold().count() == 0 and log.ops().count() == 0
    a, b = log.begin("idle", 1000), log.begin("manual", 5)
    op = lambda p, **k: spark.createDataFrame([tuple((dict(pass_id=p, step="s", policy="auto", kind="k", target="t", detail=None, inverse=None, applied=True) | k).values())], OP)
    log.record(op(a))
    log.record(op(a, policy="approval", applied=False).union(op(b)))
    for bad in (op(a, step=" "), op(a, policy="maybe"), op(a, target=None), op("nobody")):
        with pytest.raises(ValueError):
            log.record(bad)
    assert log.ops(a).count() == 2 and log.ops().count() == 3
    with pytest.raises(ValueError):
        log.begin("whim", 5)
    with pytest.raises(KeyError):
        log.end("nobody")
    assert log.end(a) and not log.end(a)
    assert [r.pass_id for r in log.untold().collect()] == [a]
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: PassLog(spark, str(tmp_path)).mark_told(a, f"agent{i}"), range(8))) == 1
    assert log.untold().count() == 0 and log.passes().count() == 2


def test_pass_log_by_order(spark):
    rows = [("a", 1, "op"), ("a", 2, "begin"), ("a", 3, "op"), ("a", 4, "tell"), ("a", 5, "end"), ("a", 6, "end"), ("a", 7, "op"), ("a", 8, "tell"), ("a", 9, "tell"), ("b", 10, "begin"), ("b", 11, "op"), ("c", 12, "end")]
    got = sorted(map(tuple, fold(spark.createDataFrame(rows, "pass_id string, id long, what string")).collect()))
    assert got == [("a", 1, 5, 8), ("b", 1, None, None)]


def test_epochs_with_a_gap(spark):
    names = "id long, epoch int, v string"
    base = spark.createDataFrame([(1, 5, "old"), (2, 3, "old"), (3, 5, "old")], names)
    late = spark.createDataFrame([(1, 4, "stale"), (2, 6, "new"), (3, 5, "same"), (4, 2, "first"), (2, 8, "newest")], names)
    rows, state = V.splice(base, late, 5)
    assert {r.id: (r.epoch, r.v) for r in rows.collect()} == {1: (5, "old"), 2: (8, "newest"), 3: (5, "same"), 4: (2, "first")}
    assert tuple(state.first()) == (8, 1, True)
    assert tuple(V.splice(base, late.where("epoch <= 6"), 5)[1].first()) == (6, 0, False)
    assert tuple(V.splice(base, late.limit(0), 5)[1].first()) == (5, 0, False)


def test_registered_embedders(spark):
    from tallyarc.functions import registry as G

    texts = spark.createDataFrame([(1, "aAb"), (2, None), (3, ""), (4, "123 é")], "id long, text string")
    got = {r.id: r.embedding for r in G.embed(texts, "letters").collect()}
    assert got[2] is None and got[3] is None and got[4] is None
    assert [round(x, 6) for x in got[1][:3]] == [round(2 / 5**0.5, 6), round(1 / 5**0.5, 6), 0] and len(got[1]) == 26
    G.register_embedder("sizes", 2, lambda t: [(len(x), float("nan") if x == "" else 1) for x in t])
    assert {r.id: r.embedding is None for r in G.embed(texts, "sizes").collect()} == {1: False, 2: True, 3: True, 4: False}
    G.register_embedder("wrong", 3, lambda t: [(1, 2)] * len(t))
    with pytest.raises(Exception, match="another length"):
        G.embed(texts, "wrong").collect()

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from tallyarc.llm import queries
from tallyarc.llm.common import table


def hidden(texts):
    """Texts with personal data replaced by the names of its kinds, in plain Python."""
    from tests.llm.test_pii import RULES, brute, brute_discovered

    names, found = [k for k, *_ in RULES], {i: [] for i in texts}
    for i, t in texts.items():
        for name, a, b in (x.split(":") for x in brute(t).split(",") if x):
            found[i].append((int(a), names.index(name), int(b)))
    ids = list(texts)
    for (n, a, b), k in brute_discovered([texts[i] or "" for i in ids]).items():
        found[ids[n]].append((a, k, b))
    out = {}
    for i, t in texts.items():
        at, parts = 0, []
        for a, k, b in sorted(found[i]):
            if a >= at:
                parts += [t[at:a], f"[{names[k].upper()}]"]
            at = max(at, b)
        out[i] = "".join(parts) + t[at:] if found[i] else t
    return out


def test_stages(spark, sf_dir):
    """Each stage on what its predecessor kept: rows, columns, and decisions against brute force."""
    from tests.llm.test_jaccard import brute
    from tests.llm.test_linededup import brute as lines
    from tests.llm.test_passages import brute as passages

    docs = table(spark, sf_dir, "documents").cache()
    kept = C.STAGES[0][1](spark, docs, sf_dir).cache()
    before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in kept.collect()}
    assert after <= before and kept.columns == docs.columns
    rows = [(r.doc_id, r.text, 0) for r in kept.collect()]
    gone = lines(rows)
    clean = C.STAGES[1][1](spark, kept, sf_dir).cache()
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t, _ in rows}
    got = {r.doc_id: r for r in clean.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values()) and clean.columns == docs.columns
    first = C.STAGES[2][1](spark, clean, sf_dir).cache()
    groups = brute([(r.doc_id, r.text) for r in got.values()], 5, 80, 100)
    assert {r.doc_id for r in first.collect()} == {c for _, c in groups.values()} and first.columns == docs.columns
    left = passages([(r.doc_id, r.text) for r in got.values() if groups[r.doc_id][1] == r.doc_id])
    assert {r.doc_id: (r.text or "").split() for r in first.collect()} == left
    redacted = C.STAGES[3][1](spark, first, sf_dir).cache()
    assert {r.doc_id: r.text for r in redacted.collect()} == hidden({r.doc_id: r.text for r in first.collect()}) and redacted.columns == docs.columns
    pieces, places, own = {}, {}, Tokenizer.from_file(C.TOKENIZER)
    for r in C.STAGES[4][1](spark, redacted, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for r in redacted.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        cut = range(0, len(ids), C.CAPACITY)
        want[r.doc_id] = [(k, at, len(ids[at : at + C.CAPACITY]), zlib.crc32(ids[at : at + C.CAPACITY].tobytes())) for k, at in enumerate(cut)]
    assert {i: sorted(x) for i, x in pieces.items()} == want
    for row in places.values():
        row.sort()
        ends = [offset + length for offset, length in row]
        assert [offset for offset, _ in row] == [0, *ends[:-1]] and ends[-1] <= C.CAPACITY


def test_run(spark, sf_dir):
    out = C.run(spark, sf_dir).collect()
    assert out and {"doc_id", "sequence_id", "offset", "length"} <= set(out[0].asDict())


def test_all_queries():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_odd_rows_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that stages use themselves."""
    docs = table(spark, sf_dir, "documents").limit(60)
    row = docs.orderBy("doc_id").first()
    odd = [(None, row.text, None, None, None), (9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, "word " * 60_000, "en", "s", 300_000), tuple(row), tuple(row), (9004, "me@mail.org +1 (437) 555-0689", None, "s", 5)]
    clash = ("rid", "key", "score", "base", "spans", "label", "v", "c", "part", "place", "chunk")
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in clash:
        both = both.selectExpr("*", f"3 AS {name}")
    folder = str(tmp_path / "odd")
    both.write.parquet(f"{folder}/documents.parquet")
    table(spark, sf_dir, "labels").write.parquet(f"{folder}/labels.parquet")
    df = table(spark, folder, "documents")
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, df, folder)
        path = str(tmp_path / f"out{k}")
        out.write.parquet(path)
        if k < len(C.STAGES) - 1:
            assert out.columns == df.columns
            assert out.where("score <> 3 OR part <> 3").count() == 0
        df = spark.read.parquet(path)
    assert df.count() > 0 and df.where("doc_id = 9003").count() <= 15


def test_empty_table_through_run(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "none")
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert C.run(spark, folder).count() == 0

from tallyarc.llm.linededup import line_dedup


def brute(rows):
    first, gone = {}, {}
    for i, t in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        lines = t.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip()]
        out = set()
        for p in range(len(solid) - 2):
            w = tuple(lines[solid[p + k]].strip() for k in range(3))
            if w in first:
                fi, fp = first[w]
                out |= set(range(p, p + 3)) - (set(range(fp, fp + 3)) if fi == i else set())
            else:
                first[w] = (i, p)
        gone[i] = {solid[p] for p in out}
    return gone


def test_equals_brute_force(docs, rows):
    gone = brute(rows)
    out = line_dedup(docs).collect()
    assert len(out) == len(rows) and "v" in out[0].asDict()
    texts = {i: t for i, t, _ in rows}
    for r in out:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        t = texts[r.doc_id]
        assert r.n_removed == len(gone[r.doc_id])
        want = t if not gone[r.doc_id] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id])
        assert r.text == want
    assert any(gone.values())


def test_runs_of_equal_lines(spark):
    df = spark.createDataFrame([(1, "a\na\na\na\na\na"), (2, "a\n\na\na"), (3, "x\ny"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed) for r in line_dedup(df).collect()}
    assert got == {1: ("a\na\na", "3:6"), 2: ("", "0:1,2:4"), 3: ("x\ny", ""), 4: (None, "")}


def test_empty(nothing):
    assert line_dedup(nothing).count() == 0

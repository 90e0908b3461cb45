"""Queries without SQL read every row and the whole text."""

import json
from types import SimpleNamespace

from tallyarc.functions import compact as C
from tallyarc.plans import compaction, scalars, search
from tallyarc.views import Views


def test_json_and_hashes_of_all_entries(spark):
    rows = [(i, f"s{i % 2}", "idea", 3, 7, f"title {i}", f"text {i}") for i in range(1, 1001)]
    v = SimpleNamespace(entries=spark.createDataFrame(rows, "id long, project_id string, kind string, access_count long, valid_days long, title string, summary string"))
    tables = compaction.json_crush(v).collect()
    assert sorted(x["id"] for r in tables for x in json.loads(C.restore(r.table))) == list(range(1, 1001))
    assert sorted(r.id for r in compaction.simhash64(v).collect()) == list(range(1, 1001))


def test_search_finds_what_stands_late_in_a_text(spark, tmp_path):
    word = search.TOKENS[0][1]
    texts = ["filler " * 200 + word, *(f"other words {i}" for i in range(12))]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    assert v.entries.where(f"id = 1 and contains(summary, '{word}')").count() == 1
    assert 1 in {r.id for r in search.appraise_stemmed(v).collect()}


def test_word_pieces_of_whole_texts(spark):
    v = SimpleNamespace(entries=spark.createDataFrame([(1, "on", "the " * 400 + "tan"), (2, None, None), (3, "an", "")], "id long, title string, summary string"))
    got = {r.id: r.pieces.split() for r in scalars.wordpiece_tokenize(v).collect()}
    assert got == {1: ["the"] * 400 + ["t", "##an"], 2: [], 3: []}

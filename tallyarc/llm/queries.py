"""The queries of this subpackage: thin, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyarc.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def held_out(parts: int, rest: int) -> Column:
    """Whether a row is of the fold that training must not see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query
def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.embedjoin import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), t=0.95)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyarc.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.linededup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op2_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query
def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.pii import NAMES, pii_spans, spans_text

    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS long)").alias(f"n_{name}") for k, name in enumerate(NAMES)]
    return found.select("doc_id", *count, F.sha2(F.expr(spans_text("base")), 256).alias("base_sha256"), F.expr(spans_text("spans")).alias("spans"))


@query
def op1_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.quality import fit, quality_scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_scores(docs, fit(docs, labels.where(~held_out(4, 2))))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_gated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.toxicity import fit, toxicity_scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity_scores(docs, fit(docs, labels.where(~held_out(5, 0))))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.fingerprints import edited_fingerprints, with_near

    return with_near(edited_fingerprints(table(spark, sf_dir, "documents")), radius=3, wide=16)


@query
def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyarc.llm.sptok import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.periodic import looped, periodic_runs

    out = periodic_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = "aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    out = out.withColumn("best", F.expr(best)).withColumn("lines", F.expr(lines))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyarc.llm.language import fit, languages_of

    docs = table(spark, sf_dir, "documents")
    out = languages_of(docs, fit(docs.where(~held_out(4, 2))))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyarc.llm.crosstok import aligned

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_COMPONENTS = """walk AS (SELECT id, id AS c FROM node UNION SELECT e.b, w.c FROM walk w JOIN edge e ON e.a = w.id), comp AS (SELECT id, min(c) AS component_id FROM walk GROUP BY id)"""

ORACLE_SQL["op3_embedding_neardup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ok AS (SELECT * FROM v WHERE list_sum(list_transform(x, lambda y: y * y)) > 0),
    edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 95e-2), node AS (SELECT vec_id AS id FROM v), {_COMPONENTS}
    SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN (SELECT a, count(*) AS n FROM edge GROUP BY a) l ON l.a = id"""

ORACLE_SQL["op9_line_windows"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS i FROM d),
    s AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM l WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
    w AS (SELECT * FROM (SELECT doc_id, p, t, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)) x WHERE t2 IS NOT NULL),
    f AS (SELECT t, t1, t2, min(struct_pack(d := doc_id, p := p)) AS f FROM w GROUP BY ALL HAVING count(*) > 1),
    later AS (SELECT w.doc_id, w.p, CASE WHEN f.f.d = w.doc_id THEN f.f.p ELSE -10 END AS fp FROM w JOIN f USING (t, t1, t2) WHERE NOT (f.f.d = w.doc_id AND f.f.p = w.p)),
    gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) AS v(k) WHERE NOT (p + k BETWEEN fp AND fp + 2)),
    out AS (SELECT g.doc_id, s.i, s.i - row_number() OVER (PARTITION BY g.doc_id ORDER BY s.i) AS island FROM gone g JOIN s ON s.doc_id = g.doc_id AND s.p = g.p),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM out GROUP BY doc_id, island),
    r AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, string_agg(concat(CAST(a AS VARCHAR), ':', CAST(b AS VARCHAR)), ',' ORDER BY a) AS removed FROM runs GROUP BY doc_id),
    kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN out o ON o.doc_id = l.doc_id AND o.i = l.i WHERE o.i IS NULL GROUP BY l.doc_id)
    SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE len(d.ls) END AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed, sha256(coalesce(kept.text, '')) AS text_sha256
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

ORACLE_SQL["op10_ngram_jaccard"] = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    edge AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), node AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
    SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM comp LEFT JOIN n ON n.doc_id = id"""

ORACLE_SQL["op11_periodic_runs"] = r"""WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda h, x: xor(xor(h, x) >> 1, 3988292384::UBIGINT * (xor(h, x) & 1))) AS inverse FROM documents),
    num AS (SELECT doc_id, w, len(w) AS n, CAST(xor(inverse, 4294967295::UBIGINT) AS BIGINT) AS h FROM raw),
    lp AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM num), lq AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM lp),
    d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(generate_series(0, n - 1), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) END AS w FROM lq),
    words AS (SELECT doc_id, n, unnest(w) AS word, unnest(generate_series(0, n - 1)) AS i FROM d WHERE n > 0),
    pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    island AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair) t GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
    run AS (SELECT * FROM island x WHERE NOT EXISTS (SELECT 1 FROM island y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)),
    stat AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
    best AS (SELECT * FROM run x WHERE NOT EXISTS (SELECT 1 FROM run y WHERE y.doc_id = x.doc_id AND
        ((y.e - y.s) * x.q > (x.e - x.s) * y.q OR (y.e - y.s) * x.q = (x.e - x.s) * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q)))),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s + q, e - 1)) AS i FROM run),
    kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", e - s AS length, q AS period, 1000 * (e - s) // q AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
    FROM d LEFT JOIN stat USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

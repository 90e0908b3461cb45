"""Operator 6: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities that four patterns find and checks confirm. Seeds and other identifier-like tokens (those with a digit
or an at sign) are instances. A lexical pattern is what stands beside a token, whatever the token looks like: the word or the two
words on its left or right, one on each side, or the key before it and an equals sign or colon. On the graph of patterns and
instances, scores pass from instances to patterns (the share of a pattern's different values that are trusted, so copies of a
text count once) and back (the best pattern of an instance, counted less where the token is not made like that kind), a
fixed number of rounds; patterns with enough different seeds and trust give the tokens they hold their kind. Seeds always stay.

Offsets are code points, ends exclusive. Each pattern runs in time linear in a text: where a run can be entered only at its
start or where the last match ended, a lookbehind says so and quantifiers are possessive, which changes no match.

Rows: a null text is an empty one, without spans; repeated rows give a row each; other columns are kept where the caller has
them. Instances of rows without doc_id take part too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch

#: Kinds in order, a cheap test of the text, the pattern, and the check of a match ``x.m``.
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = [
    ("email", "contains(text, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    ("ip", r"text rlike r'[0-9]\.[0-9]'", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"x.m rlike r'^{BYTE}(\.{BYTE}){{3}}$'"),
    ("card", "text rlike '[0-9](?:[ -]?[0-9]){11}'", r"[0-9](?:[\x20-]?[0-9])++", f"length({DIGITS}) between 12 and 19 and luhn_check({DIGITS})"),
    ("phone", r"text rlike r'\+[0-9]'", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) between 9 and 15"),
]
NAMES = [k for k, *_ in KINDS]
#: Identifier-like tokens; what is cut from their start (a key and its sign, punctuation) and end; how much text around a token is looked at.
TOKEN, HEAD, TAIL, AROUND = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", r"^(?:[A-Za-z][A-Za-z0-9_.-]*[=:]++)?[.,;:!?(\[{<\"'#$%&*|=]*", r"[.,;:!?)\]}>\"'#$%&*|]+$", 40
#: How tokens of each kind are made, roughly, and what the trust of a pattern is times for a token that is made otherwise.
MADE, OTHERWISE = ["at", "dots", "digits", "digits"], 0.95
#: Rounds of scoring, seeds that a pattern needs, its least trust.
ROUNDS, SEEDS, TRUST = 3, 5, 0.9
_SPAN = "struct<start:int,k:int,end:int,m:string>"


def _found(k: int, test: str, pattern: str, check: str) -> str:
    """SQL for the checked matches of a pattern in ``text``, as an array of spans. Splitting gives the text between matches."""
    fold = f"""aggregate(
        zip_with(regexp_extract_all(text, r'{pattern}', 0), split(text, r'{pattern}', -1), (m, gap) -> named_struct('m', m, 'gap', gap)),
        cast(named_struct('at', 0, 'out', array()) AS struct<at:int,out:array<{_SPAN}>>),
        (acc, x) -> named_struct('at', acc.at + length(x.gap) + length(x.m), 'out', array_append(acc.out, named_struct(
            'start', acc.at + length(x.gap), 'k', {k}, 'end', acc.at + length(x.gap) + length(x.m), 'm', x.m)))).out"""
    return f"CASE WHEN {test} THEN filter({fold}, x -> x.m IS NOT NULL AND {check}) ELSE cast(array() AS array<{_SPAN}>) END"


def base_spans() -> str:
    """SQL for all seeds of ``text`` by start, then kind."""
    found = ", ".join(_found(k, test, pattern, check) for k, (_, test, pattern, check) in enumerate(KINDS))
    return f"CASE WHEN text rlike '[0-9@]' THEN array_sort(concat({found})) ELSE cast(array() AS array<{_SPAN}>) END"


def spans_text(column: str) -> str:
    kind = f"element_at(array({', '.join(repr(k) for k in NAMES)}), x.k + 1)"
    return f"array_join(transform({column}, x -> concat({kind}, ':', x.start, ':', x.end)), ',')"


def _instances(rows: DataFrame) -> DataFrame:
    """A row for each pattern of each instance: ``rid, start, end, k`` (null: not a seed), ``made``, ``value`` and ``pattern``."""
    word, gap = r"[\\p{L}\\p{N}]+", r"[^\\p{L}\\p{N}]"
    near = f"""transform(tokens, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k, 'm', x.m,
        'left', lower(substring(text, greatest(x.start - {AROUND}, 0) + 1, least(x.start, {AROUND}))), 'right', lower(substring(text, x.end + 1, {AROUND}))))"""
    each = rows.where("size(tokens) > 0").selectExpr("rid", f"inline({near})")
    made = r"CASE WHEN contains(m, '@') THEN 'at' WHEN m rlike r'\p{L}' THEN 'mixed' WHEN m rlike r'[0-9]\.[0-9]' THEN 'dots' ELSE 'digits' END"
    part = lambda side, rx: f"regexp_replace(regexp_extract({side}, '{rx}', 1), '[0-9]', '0')"
    l, r = part("left", f"({word}){gap}*$"), part("right", f"^{gap}*({word})")
    two = part("left", f"({word}{gap}+{word}){gap}*$"), part("right", f"^{gap}*({word}{gap}+{word})")
    key = part("left", r"([\\p{L}\\p{N}_-]+)\\s*[=:]+[\\s(\\x22\\x27]*$")
    both = each.selectExpr("rid", "start", "end", "k", f"{made} AS made", "xxhash64(lower(m)) AS value", f"{l} AS l", f"{r} AS r", f"{two[0]} AS ll", f"{two[1]} AS rr", f"{key} AS key")
    some = lambda name, of: f"CASE WHEN {of} <> '' THEN concat('{name} ', {of}) END"
    pattern = f"explode(array_compact(array({some('L', 'l')}, {some('R', 'r')}, CASE WHEN l <> '' AND r <> '' THEN concat('B ', l, ' ', r) END, {some('LL', 'll')}, {some('RR', 'rr')}, {some('K', 'key')}))) AS pattern"
    return both.selectExpr("rid", "start", "end", "k", "made", "value", pattern)


def discovered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(rid, start, end, k)`` of tokens that trusted patterns hold. Patterns may be hot: their values are summed before the shuffle."""
    graph = scratch.keep(_instances(rows).withColumn("score", F.when(F.col("k").isNotNull(), 1.0).otherwise(0.0)))
    seeds = [F.count(F.when(F.col("k") == i, 1)).alias(f"s{i}") for i in range(len(KINDS))]
    for turn in range(ROUNDS):
        values = graph.groupBy("pattern", "value").agg(F.max("score").alias("score"), F.min("k").alias("k"))
        patterns = values.groupBy("pattern").agg(F.sum("score").alias("trusted"), F.count("*").alias("n"), *seeds)
        most = F.greatest(*(F.col(f"s{i}") for i in range(len(KINDS))))
        kind = F.coalesce(*(F.when(F.col(f"s{i}") == most, F.lit(i)) for i in range(len(KINDS))))
        patterns = patterns.where(most >= SEEDS).select("pattern", (F.col("trusted") / (F.col("n") + 1) * most / (F.expr(" + ".join(f"s{i}" for i in range(len(KINDS)))))).alias("trust"), kind.alias("kind"))
        alike = F.coalesce(*(F.when(F.col("kind") == i, F.col("made") == made) for i, made in enumerate(MADE)))
        told = graph.where("k IS NULL").join(patterns, "pattern").withColumn("trust", F.col("trust") * F.when(alike, 1.0).otherwise(OTHERWISE))
        best = told.groupBy("rid", "start", "end").agg(F.max(F.struct("trust", (-F.col("kind")).alias("less"))).alias("b")).select("rid", "start", "end", F.col("b.trust").alias("best"), (-F.col("b.less")).alias("kind"))
        if turn == ROUNDS - 1:
            return best.where(F.col("best") >= TRUST).select("rid", "start", "end", F.col("kind").alias("k"))
        scored = graph.join(best.select("rid", "start", "end", "best"), ["rid", "start", "end"], "left")
        again = scratch.keep(scored.select("rid", "start", "end", "k", "made", "value", "pattern", F.when(F.col("k").isNotNull(), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
        scratch.drop(graph)
        graph = again


def pii_spans(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with ``base`` (seeds) and ``spans`` (seeds and discovered tokens), arrays of (start, kind number, end). Columns that
    have these names already are replaced."""
    docs = docs.drop(base, spans)
    scratch = Scratch(docs.sparkSession, "pii")
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(c) for c in kept)).alias("doc"), F.col("text").alias("given"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("seeds", F.expr(base_spans()))
    other = _found(-1, "text rlike '[0-9@]'", TOKEN, "true")
    head, tail = (x.replace("'", r"\x27") for x in (HEAD, TAIL))
    cut = f"transform({other}, x -> named_struct('start', x.start + length(regexp_extract(x.m, r'{head}', 0)), 'k', x.k, 'end', x.end - length(regexp_extract(x.m, r'{tail}', 0)), 'm', regexp_replace(regexp_replace(x.m, r'{tail}', ''), r'{head}', '')))"
    free = f"filter({cut}, t -> length(t.m) > 0 AND NOT exists(seeds, s -> s.start < t.end AND t.start < s.end))"
    tokens = f"concat(seeds, transform({free}, x -> named_struct('start', x.start, 'k', cast(null AS int), 'end', x.end, 'm', x.m)))"
    rows = rows.withColumn("tokens", F.expr(f"CASE WHEN text rlike '[0-9@]' THEN {tokens} ELSE cast(array() AS array<{_SPAN}>) END"))
    rows = scratch.keep(rows)
    more = discovered(rows, scratch).groupBy(F.col("rid").alias("own")).agg(F.collect_list(F.struct("start", "k", "end")).alias("more"))
    bare = "transform(seeds, x -> named_struct('start', x.start, 'k', x.k, 'end', x.end))"
    none = rows.where("size(tokens) = size(seeds)").selectExpr("doc", "given", f"{bare} AS base", f"{bare} AS spans")
    some = rows.where("size(tokens) > size(seeds)").join(more, F.col("rid") == F.col("own"), "left")
    some = some.selectExpr("doc", "given", f"{bare} AS base", f"array_sort(concat({bare}, coalesce(more, array()))) AS spans")
    out = none.unionByName(some)
    return out.select(*(F.col("given").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns), F.col("base").alias(base), F.col("spans").alias(spans))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of spans that overlap, the earliest counts."""
    found = pii_spans(docs, "_pii_base", "_pii_spans")
    kind = f"element_at(array({', '.join(repr(k.upper()) for k in NAMES)}), x.k + 1)"
    fold = f"""aggregate(_pii_spans, named_struct('at', 0, 'out', ''), (acc, x) -> CASE WHEN x.start < acc.at THEN named_struct('at', greatest(acc.at, x.end), 'out', acc.out)
        ELSE named_struct('at', x.end, 'out', concat(acc.out, substring(text, acc.at + 1, x.start - acc.at), '[', {kind}, ']')) END,
        acc -> concat(acc.out, substring(text, acc.at + 1, length(text) - acc.at)))"""
    return found.withColumn("text", F.expr(f"CASE WHEN size(_pii_spans) > 0 THEN {fold} ELSE text END")).drop("_pii_base", "_pii_spans")

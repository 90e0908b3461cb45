"""Queries of the graph operators."""

from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.operators import graph as G
from tallyarc.views import Views

_WALK = """WITH RECURSIVE w AS (SELECT from_id AS seed, to_id AS id, 1 AS distance, from_id AS via, [from_id, to_id] AS path FROM {links} WHERE from_id IN (1, 7, 20)
    UNION ALL SELECT w.seed, l.to_id, w.distance + 1, l.from_id, list_append(w.path, l.to_id) FROM w JOIN {links} l ON l.from_id = w.id WHERE w.distance < {depth} AND NOT list_contains(w.path, l.to_id))"""
_FIRST = "SELECT seed, id, distance, via, '{d}' AS direction FROM (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY distance, via) AS rn FROM w) x WHERE rn = 1"
_IN = "(SELECT to_id AS from_id, from_id AS to_id, relation FROM entry_links)"


def _seeds(v: Views):
    return v.entries.where("id IN (1, 7, 20)").select(F.col("id").alias("seed"))


@query("ripples", _WALK.format(links="entry_links", depth=4) + _FIRST.format(d="out"))
def ripples(v: Views):
    return G.ripples(v.entry_links, _seeds(v), 4)


@query("ripples_in", _WALK.format(links=_IN, depth=3) + _FIRST.format(d="in"))
def ripples_in(v: Views):
    return G.ripples(v.entry_links, _seeds(v), 3, "in")


@query("ripples_both", _WALK.format(links="entry_links", depth=2).replace("w AS", "wo AS").replace("FROM w ", "FROM wo ").replace("w.", "wo.") + ", " + _WALK.format(links=_IN, depth=2)[15:].replace("w AS", "wi AS").replace("FROM w ", "FROM wi ").replace("w.", "wi.")
    + _FIRST.format(d="out").replace("FROM w)", "FROM wo)") + " UNION ALL " + _FIRST.format(d="in").replace("FROM w)", "FROM wi)"))
def ripples_both(v: Views):
    return G.ripples(v.entry_links, _seeds(v), 2, "both")


@query("ripples_relation", _WALK.format(links="(SELECT * FROM entry_links WHERE relation = 'informs')", depth=4) + _FIRST.format(d="out"))
def ripples_relation(v: Views):
    return G.ripples(v.entry_links, _seeds(v), 4, relation="informs")


@query("ripples_via", _WALK.format(links="entry_links", depth=3) + "SELECT seed, id, via FROM (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY distance, via) AS rn FROM w) x WHERE rn = 1 AND distance = 3")
def ripples_via(v: Views):
    return G.ripples(v.entry_links, _seeds(v), 3).where("distance = 3").select("seed", "id", "via")


@query("ripples_cycles", _WALK.format(links="entry_links", depth=5) + "SELECT seed, count(*) - count(DISTINCT id) AS cycles FROM w GROUP BY seed")
def ripples_cycles(v: Views):
    return G.cycles(v.entry_links, _seeds(v), 5)


@query("ripples_text", _WALK.format(links="entry_links", depth=2) + "SELECT seed, string_agg(concat(repeat('  ', distance), 'ENTRY-', CAST(id AS VARCHAR)), chr(10) ORDER BY distance, id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY distance, via) AS rn FROM w) x WHERE rn = 1 GROUP BY seed")
def ripples_text(v: Views):
    rows = G.ripples(v.entry_links, _seeds(v), 2).select("seed", F.struct("distance", "id", F.concat(F.repeat(F.lit("  "), F.col("distance")), F.lit("ENTRY-"), F.col("id").cast("string")).alias("line")).alias("r"))
    return rows.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("text"))

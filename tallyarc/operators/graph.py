"""Bounded walks over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 10


def _edges(links: DataFrame, direction: str, relation: str | None) -> DataFrame:
    own = links.where(F.col("relation") == relation) if relation else links
    a, b = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    return own.select(F.col(a).alias("src"), F.col(b).alias("dst"), "relation")


def ripples(links: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", relation: str | None = None) -> DataFrame:
    """Nodes within ``depth`` links of each seed ``(seed)``: ``seed, id, distance, via, direction``. A breadth-first walk: a node is
    visited at its smallest distance, through its smallest neighbour; ``both`` is two walks."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 0 to {MOST_DEPTH}")
    if direction == "both":
        return ripples(links, seeds, depth, "out", relation).unionByName(ripples(links, seeds, depth, "in", relation))
    edges = _edges(links, direction, relation)
    seen = front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("long").alias("via"))
    for d in range(1, depth + 1):
        step = front.join(edges, front.id == edges.src).groupBy("seed", F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        front = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("distance"), "via")
        seen = seen.unionByName(front)
    return seen.where("distance > 0").withColumn("direction", F.lit(direction))


def paths(links: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Simple paths from each seed, as rows of their ends. Their number can grow with the power of the depth."""
    edges = _edges(links, direction, None)
    front = seeds.select("seed", F.col("seed").alias("id"), F.array("seed").alias("path"))
    out = None
    for d in range(1, depth + 1):
        step = front.join(edges, front.id == edges.src).where(~F.array_contains("path", F.col("dst")))
        front = step.select("seed", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        own = front.select("seed", "id", F.lit(d).alias("distance"))
        out = own if out is None else out.unionByName(own)
    return out


def cycles(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """How many further paths there are to nodes that a walk has already reached."""
    return paths(links, seeds, depth).groupBy("seed").agg((F.count("*") - F.count_distinct("id")).alias("cycles"))

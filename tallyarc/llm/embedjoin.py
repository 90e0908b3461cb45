"""Operator 3: embedding near-dedup by an epsilon grid order join.

Two vectors have cosine t or more exactly if their unit vectors are within eps = sqrt(2 - 2 t). Unit vectors are projected on
leading principal dimensions (fitted on a bounded sample; any basis is exact, a fitted one prunes more), ordered by the grid
cells of width eps on these, and cut into blocks of the sequence. Intervals of the sequence form a tree with bounding boxes;
pairs of intervals are joined recursively from the root, those whose boxes are farther apart than eps are skipped, first over
whole blocks in Spark, then inside a pair of blocks down to strips, where cosines are computed in double precision.

Equal vectors are joined once. A pair of blocks gives how many vectors each one links to, and as links only a spanning forest
of them, so a group of n near copies costs O(n) rows. Vectors of each length are joined by themselves, one length after the other.
Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows without vec_id (their component is
null). Every row gives a row; rows of one vec_id with equal vectors count as one vector. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import Scratch, components

#: Vectors in a block, children of an interval, principal dimensions, vectors that the basis is fitted on, smallest strip, bytes of a
#: band's vectors.
BLOCK, FANOUT, DIMS, SAMPLE, STRIP, BAND = 2048, 8, 6, 4096, 256, 32_000_000


def _checked(it):
    for batch in it:
        ids, keys, data, dims = [], [], [], []
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.array([np.nan if y is None else y for y in v or []], np.float64)
            with np.errstate(over="ignore"):
                norm = math.sqrt(float(x @ x)) if len(x) else 0.0
                if not (math.isfinite(norm) and norm > 0) and len(x) and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()  # too large or small to square
            ok = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            ids.append(vec_id)
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
            data.append(x.tobytes() if ok else None)
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(data, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "key", "x", "dim"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _celled(basis: np.ndarray, eps: float):
    def run(it):
        for batch in it:
            cells = np.floor(_unit(_matrix(batch["x"], len(basis))) @ basis / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells.T)], [*batch.schema.names, *(f"g{i}" for i in range(basis.shape[1]))])

    return run


def _blocks(basis: np.ndarray, size: int):
    def run(it):
        part, nth = TaskContext.get().partitionId(), 0
        kept: list[pa.RecordBatch] = []

        def block(rows: pa.Table):
            nonlocal nth
            x = _matrix(rows["x"].combine_chunks(), len(basis))
            p = _unit(x) @ basis
            out = [part, nth, rows["rep"].to_numpy().astype(np.int64).tobytes(), rows["copies"].to_numpy().astype(np.int64).tobytes(), x.tobytes(), (p.min(0) - 1e-9).tolist(), (p.max(0) + 1e-9).tolist()]
            nth += 1
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], ["part", "nth", "ids", "copies", "x", "lo", "hi"])

        for batch in it:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= size:
                rows = pa.Table.from_batches(kept)
                while rows.num_rows >= size:
                    yield block(rows.slice(0, size))
                    rows = rows.slice(size)
                kept = rows.to_batches()
        rows = pa.Table.from_batches(kept) if kept else None
        if rows is not None and rows.num_rows:
            yield block(rows)

    return run


def join_blocks(a, b, same: bool, t: float, eps: float, basis: np.ndarray):
    """Links between two blocks ``(ids, copies, x)``, or inside one: link counts of both, and a spanning forest of links."""
    ids, copies = (a[0], a[1]) if same else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
    ua, ub = _unit(a[2]), _unit(b[2])
    pa_, pb = ua @ basis, ub @ basis
    shift = 0 if same else len(ua)
    links, label, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

    def distant(i, j, k, m) -> bool:
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        return float(gap @ gap) > (eps + 1e-9) ** 2

    def strip(i, j, k, m) -> None:
        cos = ua[i:j] @ ub[k:m].T
        linked = cos >= t
        edge = np.abs(cos - t) < 1e-12
        if edge.any():
            for r, c in np.argwhere(edge):
                x, y = a[2][i + r], b[2][k + c]
                linked[r, c] = x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= t
        if same and i == k:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        links[i:j] += linked @ copies[shift + k : shift + m]
        if not (same and i == k):
            links[shift + k : shift + m] += copies[i:j] @ linked
        for r in np.flatnonzero(linked.any(1)):
            cols = np.flatnonzero(linked[r]) + shift + k
            there, first = np.unique(label[cols], return_index=True)
            own = label[i + r]
            new = there != own
            if new.any():
                forest.extend((int(ids[i + r]), int(ids[cols[f]])) for f in first[new])
                label[np.isin(label, there[new])] = own

    def recurse(i, j, k, m) -> None:
        if same and k + m < i + j or distant(i, j, k, m):
            return
        if max(j - i, m - k) <= STRIP:
            strip(i, j, k, m)
            return
        h, g = (i + j + 1) // 2, (k + m + 1) // 2
        for x in ((i, h), (h, j)) if j - i > STRIP else ((i, j),):
            for y in ((k, g), (g, m)) if m - k > STRIP else ((k, m),):
                recurse(*x, *y)

    recurse(0, len(ua), 0, len(ub))
    return ids, links, forest


def _joined(basis: np.ndarray, t: float, eps: float):
    """Rows of blocks ``(tile, seq, held, meets, ids, copies, x, lo, hi)``, sorted by tile and seq: one that ``meets`` is joined with those
    of its tile that are ``held`` and come before it, and with itself if it is both."""

    def run(it):
        tile, held = None, []
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if row["tile"] != tile:
                    tile, held = row["tile"], []
                now = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64), np.frombuffer(row["x"], np.float64).reshape(-1, len(basis))
                lo, hi = np.array(row["lo"]), np.array(row["hi"])
                if row["held"]:
                    held.append((row["seq"], now, lo, hi))
                for seq, other, low, high in held if row["meets"] else ():
                    gap = np.maximum(0, np.maximum(low - hi, lo - high))
                    if float(gap @ gap) > (eps + 1e-9) ** 2:
                        continue
                    ids, links, forest = join_blocks(other, now, seq == row["seq"], t, eps, basis)
                    some = links > 0
                    ends = np.array(forest, np.int64).reshape(-1, 2)
                    u, v = np.concatenate([ids[some], ends[:, 0]]), np.concatenate([ids[some], ends[:, 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate([links[some], np.zeros(len(ends), np.int64)]))], ["a", "b", "n"])

    return run


def _sent(blocks: DataFrame, pairs: DataFrame, total: int, most: int) -> DataFrame:
    """Blocks with the tiles, pairs of bands, that they are needed in, in the order that ``_joined`` reads. Bands are as many as give the
    cluster enough tiles, or more where a band would have over ``most`` blocks."""
    wanted = math.isqrt(8 * blocks.sparkSession.sparkContext.defaultParallelism) + 1
    width = max(1, min(most, -(-total // wanted)))
    bands = -(-total // width)
    of = lambda c: F.floor(F.col(c) / width)
    first, second = of("a"), of("b")
    tile = first * bands - F.floor(first * (first - 1) / 2) + second - first  # the upper triangle, row by row
    part = lambda c, held, meets: F.struct(F.col(c).alias("seq"), held.alias("held"), meets.alias("meets"))
    both = F.explode(F.array(part("a", F.lit(True), first == second), part("b", first == second, F.lit(True))))
    needed = pairs.select(tile.cast("int").alias("tile"), both.alias("of")).select("tile", "of.*").distinct()
    return needed.join(blocks, "seq").repartitionById(bands * (bands + 1) // 2, F.col("tile")).sortWithinPartitions("tile", "seq")


def near_vectors(vectors: DataFrame, t: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each vector of ``vectors(vec_id, embedding)``; links have cosine >= t."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    eps = math.sqrt(max(0.0, 2 - 2 * t))
    lost = vectors.where("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    source = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.keep(source.mapInArrow(_checked, "vec_id long, key binary, x binary, dim int"))
    ids = rows.select("vec_id", "key")
    valid = rows.where("key is not null")
    classes = scratch.keep(valid.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("x").alias("x")))
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy("dim").collect()}  # a row for each length
    if not sizes:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")).unionByName(lost)
    lone = [d for d, n in sizes.items() if n == 1]
    named = classes.where(F.col("dim").isin(lone)).select("key", (F.col("copies") - 1).alias("n_links"), F.col("rep").alias("c"))
    for dim in sizes.keys() - lone:
        named = named.unionByName(_linked(classes.where(F.col("dim") == dim).drop("dim"), dim, t, eps, block, scratch))
    out = ids.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(lost)


def _linked(classes: DataFrame, dim: int, t: float, eps: float, block: int, scratch: Scratch) -> DataFrame:
    """``(key, n_links, c)`` for each of ``classes(key, rep, copies, x)``, vectors of one length."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("key")).limit(SAMPLE).select("x").toArrow()  # a bounded sample
    u = _unit(_matrix(sample["x"].combine_chunks(), dim))
    basis = np.linalg.eigh(u.T @ u - len(u) * np.outer(u.mean(0), u.mean(0)))[1][:, ::-1][:, : min(DIMS, dim)].copy()
    dims = basis.shape[1]
    grid = [f"g{i}" for i in range(dims)]
    celled = classes.select("rep", "copies", "x").mapInArrow(_celled(basis, eps), "rep long, copies long, x binary, " + ", ".join(f"{g} int" for g in grid))
    order = [*grid, F.xxhash64("rep")]
    parts = max(1, -(-classes.count() // (4 * block)))
    blocks = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("rep", "copies", "x")
    blocks = scratch.keep(blocks.mapInArrow(_blocks(basis, block), "part long, nth long, ids binary, copies binary, x binary, lo array<double>, hi array<double>"))

    # The sequence number of a block from how many blocks each part has: one number for each part.
    before, total = {}, 0
    for r in blocks.groupBy("part").count().orderBy("part").collect():
        before[r["part"]], total = total, total + r["count"]
    offsets = spark.createDataFrame(list(before.items()), "part long, before long")
    blocks = scratch.keep(blocks.join(offsets, "part").select((F.col("before") + F.col("nth")).alias("seq"), "ids", "copies", "x", "lo", "hi"))
    boxes = blocks.select("seq", *(F.col("lo")[i].alias(f"lo{i}") for i in range(dims)), *(F.col("hi")[i].alias(f"hi{i}") for i in range(dims)))
    levels, width = [], 1
    while True:
        level = boxes.groupBy(F.floor(F.col("seq") / width).alias("id")).agg(*(F.min(f"lo{i}").alias(f"lo{i}") for i in range(dims)), *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(dims)))
        levels.append(level.withColumn("up", F.floor(F.col("id") / FANOUT)))
        if width >= total:
            break
        width *= FANOUT
    pairs = spark.sql("SELECT 0L AS a, 0L AS b")
    for level in reversed(levels[:-1]):
        side = lambda s, level=level: level.select(*(F.col(c).alias(f"{s}_{c}") for c in level.columns))
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x_lo{i}") - F.col(f"y_hi{i}"), F.col(f"y_lo{i}") - F.col(f"x_hi{i}")), 2) for i in range(dims)), F.lit(0.0))
        pairs = pairs.join(side("x"), F.col("a") == F.col("x_up")).join(side("y"), F.col("b") == F.col("y_up")).where((F.col("x_id") <= F.col("y_id")) & (gap <= (eps + 1e-9) ** 2)).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
    work = _sent(blocks, scratch.keep(pairs), total, max(1, BAND // (8 * dim * block)))
    found = scratch.keep(work.mapInArrow(_joined(basis, t, eps), "a long, b long, n long"))

    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    member = components(found.where("a != b").select("a", "b"), scratch)
    named = classes.select("key", "rep", "copies").join(links, "rep", "left").join(member, F.col("rep") == member.v, "left")
    return scratch.keep(named.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("c", "rep").alias("c")))

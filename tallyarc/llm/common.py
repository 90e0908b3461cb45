"""What the operators share: tables, cutting of lineage, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where lineage is cut when the session names no folder (tests, one machine).
OWN_FOLDER = None
#: Rows of a file of a kept table at least, where the table is known to have few.
ROWS_A_FILE = 250_000


_kept: tuple[str, object] | None = None


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What a worker process remembers between tasks: the cache of one operator at a time, so stages do not add theirs up."""
    global _kept
    if _kept is None or _kept[0] != name:
        _kept = None
        release()
        _kept = (name, make())
    return _kept[1]


def release() -> None:
    """Give memory that this process holds but does not use back to the system: a worker lives through many stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of this process only where that is unset and Spark is this process."""
    global OWN_FOLDER
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if OWN_FOLDER is None:
        OWN_FOLDER = tempfile.mkdtemp(prefix="tallyarc-")
    return f"file://{OWN_FOLDER}"


def slices(batch, column: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a record batch's rows with at most ``most`` bytes of text each, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to
    release()


class Scratch:
    """Tables written in the shared folder. ``keep`` writes a DataFrame and reads it back, so lineage ends there and a lost
    executor costs only the tasks that ran on it; ``drop`` removes tables that no later step reads. What a query's result reads
    stays until the driver's process ends, which removes the whole folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0, {}
        atexit.register(self._remove, self.root, quiet=True)

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: the most rows that the table can have. Few rows are then written in few files, whatever the number of
        shuffle partitions, but never in fewer than keep the cluster busy."""
        if rows is not None:
            df = df.coalesce(max(4 * self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of plans that have run: its cleaner learns of them from the garbage collectors. What the
        driver's Python no longer uses goes back to the system."""
        gc.collect()
        release()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if df is not None and (found := self.paths.pop(id(df), None)):
                self._remove(found[0])

    def _remove(self, path: str, quiet: bool = False) -> None:
        with contextlib.suppress(*([Exception] if quiet else [])):  # at the end the engine may be gone already
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, vertices: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(v, c)`` per vertex, ``c`` the smallest vertex of its component.
    ``vertices``: how many there are at most, where that is known.

    Every round each vertex takes the smallest parent among its neighbours, hands it to its own parent too, and parents are
    followed once more, so the rounds grow with the logarithm of the longest path. Only grouped minima (combined before the
    shuffle) and joins that Spark can split for skew are used; no group is gathered. The sum of all parents falls until
    nothing changes, which is how the end is seen."""
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    parents = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), vertices)
    total = None
    for _ in range(max_rounds):
        seen = both.join(parents, both.b == parents.v).groupBy("a").agg(F.min("p").alias("m"))
        best = parents.join(seen, parents.v == seen.a, "left").select("v", "p", F.least("p", F.coalesce("m", "p")).alias("m"))
        told = best.select("v", F.col("m").alias("p")).union(best.where("m < p").select(F.col("p").alias("v"), F.col("m").alias("p"))).groupBy("v").agg(F.min("p").alias("p"))
        hop = told.select(F.col("v").alias("q"), F.col("p").alias("r"))
        following = scratch.keep(told.join(hop, told.p == hop.q, "left").select("v", F.least("p", F.coalesce("r", "p")).alias("p")), vertices)
        scratch.drop(parents)
        parents = following
        now = parents.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    else:
        raise RuntimeError("connected components did not settle")
    scratch.drop(both)
    return parents.select("v", F.col("p").alias("c"))


#: Bits of an array of bits: at least and at most, as powers of two, and for each value between.
LEAST_BITS, MOST_BITS, BITS_A_VALUE = 25, 29, 16


def bitmap(ids: DataFrame, column: str, bits: int | None, spark: SparkSession):
    """A bit array over the hashes of a column's values, of ``2**bits`` bits, or (None) sized by their count within bounds (4 to 64
    MB): it may let more rows through than it should, never fewer. Words come to the driver, at most ``2**bits / 64``."""
    import numpy as np

    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_VALUE * ids.count()).bit_length()))
    spot = f"(`{column}` & {(1 << bits) - 1}L)"
    words = ids.selectExpr(f"shiftrightunsigned({spot}, 6) AS w", f"shiftleft(1L, cast({spot} & 63L AS int)) AS b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def in_bitmap(words, values):
    import numpy as np

    v = values.astype(np.int64).view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(v >> np.uint64(6)).astype(np.int64)] >> (v & np.uint64(63))) & np.uint64(1) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, kinds: tuple[tuple[int, ...], ...], sample: int, longest: int, characters: int):
    """A bounded sample of labelled texts as a frame ``(doc_id, text, label)``: for each group of labels in ``kinds`` the first rows by
    the hash of doc_id, at most ``sample``, texts of at most ``longest`` characters and ``characters`` together. Ids and lengths are
    chosen first, so no text travels that is not taken. A null text is an empty one; equal rows are one."""
    own = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    sized = texts.select("doc_id", "key", F.length("text").alias("n")).where(F.col("n") <= longest).distinct().join(own, "doc_id")
    taken = []
    for group in kinds:
        room = characters
        for r in sized.where(F.col("label").isin(*group)).orderBy(F.xxhash64("doc_id"), "doc_id", "key", "label").limit(sample).collect():
            if r.n <= room:
                room -= r.n
                taken.append((r.doc_id, r.key, r.label))
    chosen = docs.sparkSession.createDataFrame(taken, sized.select("doc_id", "key", "label").schema)
    rows = texts.join(F.broadcast(chosen), ["doc_id", "key"])  # at most `sample` rows of each group
    return rows.dropDuplicates(["doc_id", "key", "label"]).select("doc_id", "text", "label").toArrow().to_pandas().sort_values(["doc_id", "text", "label"])

"""Functions of this package for SQL, and a search in one call."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, LongType, StringType

from tallyarc.functions.compact import simhash64
from tallyarc.functions.text import porter_stem, query_tokens


@F.pandas_udf(ArrayType(StringType()))
def _tokenize(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: query_tokens(x or ""))


@F.pandas_udf(LongType())
def _simhash64(texts: pd.Series) -> pd.Series:
    """The 64 bits as a signed number."""
    return texts.map(lambda x: (simhash64(x or "") ^ (1 << 63)) - (1 << 63))


@F.pandas_udf(ArrayType(ByteType()))
def _quantize(vectors: pd.Series) -> pd.Series:
    import numpy as np

    def one(v):
        if v is None or any(x is None for x in v):
            return None
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all() or not x.any():
            return None
        return np.clip(np.trunc(x * 127 + np.copysign(0.5, x)), -128, 127).astype(np.int8).tolist()

    return vectors.map(one)


#: Functions by the name that SQL calls them by. More can be put in before ``register``.
FUNCTIONS = {"tokenize": _tokenize, "porter_stem": porter_stem, "simhash64": _simhash64, "quantize_int8": _quantize}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL of this session; gives their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)


#: Embedders by name: how many numbers a vector has, and the function from texts to vectors.
EMBEDDERS: dict[str, tuple[int, Callable[[pd.Series], Iterable[Sequence[float]]]]] = {}


def register_embedder(name: str, dim: int, f: Callable[[pd.Series], Iterable[Sequence[float]]]) -> None:
    """Make ``f`` known: it gets a batch of texts (null: empty) on an executor and gives a vector of ``dim`` numbers for each."""
    EMBEDDERS[name] = dim, f


def letters(texts: pd.Series) -> list[list[int]]:
    """How often each letter from a to z stands in a text, in either case: an embedder without a model."""
    return [[t.count(c) + t.count(c.upper()) for c in ascii_lowercase] for t in texts]


register_embedder("letters", len(ascii_lowercase), letters)


def embed(texts: DataFrame, name: str) -> DataFrame:
    """``(id, embedding)`` of ``texts(id, text)`` by a registered embedder, batch by batch: unit vectors, or null where a vector is zero or not
    finite. A vector of another length is an error."""
    dim, f = EMBEDDERS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            out = []
            for v in f(frame["text"].fillna("")):
                x = np.asarray(v, np.float64)
                if x.shape != (dim,):
                    raise ValueError(f"{name} gave a vector of another length than {dim}")
                size = np.sqrt((x * x).sum())
                out.append((x / size).tolist() if np.isfinite(size) and size > 0 else None)
            yield pd.DataFrame({"id": frame["id"], "embedding": out})

    return texts.select("id", F.col("text").cast("string").alias("text")).mapInPandas(run, "id long, embedding array<double>")


def search(query: str, corpus: DataFrame, limit: int = 10, stem: bool = False) -> DataFrame:
    """The best entries of ``corpus(id, title, summary, tags)`` for one query: ``(id, title, score, rank)``."""
    from tallyarc.functions.text import _porter
    from tallyarc.operators.search import lexical

    spark = corpus.sparkSession
    tokens = [(1, _porter.stem(t) if stem else t) for t in dict.fromkeys(query_tokens(query))]
    queries = spark.createDataFrame([(1, query)], "qid int, query string")
    return lexical(corpus, corpus, queries, spark.createDataFrame(tokens, "qid int, token string"), limit, stem).drop("qid")

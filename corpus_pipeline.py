"""The corpus pipeline: documents are judged, cleaned of repeated lines and near copies, redacted, and packed into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's rows in the shared folder and reads them again for the next, so a lost executor costs one stage's
tasks at most. A null text counts as an empty one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tallyarc.llm.common import Scratch, release, table
from tallyarc.llm.jaccard import keep_first_of_group
from tallyarc.llm.linededup import line_dedup
from tallyarc.llm.packing import pack
from tallyarc.llm.passages import passage_dedup
from tallyarc.llm.pii import redact
from tallyarc.llm.quality import fit, keep_good
from tallyarc.llm.queries import held_out
from tallyarc.session import ship

#: Words of a shingle, similarity in hundredths, tokens of a sequence, the tokenizer's file.
SHINGLE, SIMILAR, CAPACITY, TOKENIZER = 5, 80, 4096, public_tokenizers.path("word_bpe_49k.json")


def _counted(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like``, ``n_chars`` counted anew."""
    if "n_chars" in df.columns:
        df = df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))
    return df.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject. It learns from the labelled rows that are not held out."""
    ship(spark)
    weights = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    release()  # what training took of the driver's memory
    return keep_good(docs, weights)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated windows of three lines."""
    ship(spark)
    return _counted(line_dedup(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near copies; in what is left, no passage
    of 50 words that occurs earlier."""
    ship(spark)
    scratch = Scratch(spark, "first")
    first = scratch.keep(keep_first_of_group(docs, SHINGLE, SIMILAR, 100).select(*docs.columns))
    scratch.sweep()
    return _counted(passage_dedup(first), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds."""
    ship(spark)
    return _counted(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    ship(spark)
    return pack(docs, TOKENIZER, CAPACITY)


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_jaccard", near_copies), ("pii", personal_data), ("packing", packing)]

#: The trained network has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch, before = Scratch(spark, "pipeline"), None
    df = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        df = scratch.keep(stage(spark, df, sf_dir))
        scratch.drop(before)
        before = df
    return STAGES[-1][1](spark, df, sf_dir)

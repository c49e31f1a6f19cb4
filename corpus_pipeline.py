"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  A stage's result is
written as Parquet to the shared folder and read again.  Part of ``tillroll.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, jaccard, lines, mixing, toxicity
from tillroll.llm.common import table
from tillroll.session import write_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of words go; ``n_chars`` follows the text, unchanged texts keep theirs."""
    out = lines.dedup_passages(docs)
    changed = ~F.col("ld_text").eqNullSafe(F.col("text"))
    return out.select(*[
        F.col("ld_text").alias(c) if c == "text"
        else F.when(changed, F.length("ld_text")).otherwise(F.col(c)).cast(kind).alias(c) if c == "n_chars"
        else F.col(c) for c, kind in docs.dtypes])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_sources(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Learned scores and BPE merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs

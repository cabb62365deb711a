"""A corpus from raw documents to packed sequences, each stage written and read again by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns
of documents, with n_chars following the text. Their decisions take effect:
documents that toxicity rejects go, repeated lines go, of each group of near
copies the document with the smallest doc_id stays, repeated strings of 100
bytes go, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgeline.llm import line_runs, packing, simhash, suffixes
from hedgeline.llm import toxicity as toxic
from hedgeline.llm.common import Scratch, released, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half, unchanged."""
    small_batches(spark)
    scored = toxic.scored_rows(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more have, but for the one with the largest doc_id."""
    return _documents(line_runs.dedup_lines(docs.select(*COLUMNS), Scratch(spark, "pipeline-lines")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; documents without one stay."""
    small_batches(spark)
    groups = simhash.near_duplicates(docs, Scratch(spark, "pipeline-simhash"))
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that stand earlier; a character that loses a byte goes whole."""
    small_batches(spark)
    return _documents(suffixes.without_repeats(docs.select(*COLUMNS), Scratch(spark, "pipeline-suffixes")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens."""
    small_batches(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, tokenizer, public_tokenizers.PATTERN, Scratch(spark, "pipeline-packing"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Toxicity scores and fingerprints have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with released():  # what the stage itself wrote on the way
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)

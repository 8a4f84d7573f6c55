"""A corpus pipeline of five stages over ``documents``.

Quality rules drop documents, line dedup cuts repeated passages of lines, the n-gram join keeps one
document of each group of near copies, decontamination drops documents with benchmark passages, and
packing deals what is left into sequences.

In every stage nulls and empty texts have a result (below), texts are read whole, repeated rows are
rows of their own, an empty table stays empty, and further columns of any name are kept by all stages
but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcorpus.llm.decontamination import without_leaks
from loomcorpus.llm.line_dedup import dedup_lines
from loomcorpus.llm.ngram_join import keep_one
from loomcorpus.llm.packing import pack, tokenizer_path
from loomcorpus.llm.quality import quality_filter
from loomcorpus.llm.scratch import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. Null and empty texts have too few words and go; documents
    at equal distances are judged alike."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that stood before it. A null text stays null, a text that
    is all repeats is empty; of alike rows one is the first."""
    return dedup_lines(docs, whole=True).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, and rows that
    share it. Texts without words are copies of nothing and stay."""
    return keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark. Null and empty texts have none; all rows of
    a doc_id in one of whose texts a passage is found go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences and places. A null or empty text is the end
    token alone."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL can't tokenize or estimate the scatter; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it; what is read no more is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, before, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

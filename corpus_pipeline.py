"""Corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldtrace.llm import decontaminate, jaccard_join, mixing, quality_rules, substring_dedup
from foldtrace.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near duplicates (five words, 0.8): the least id.

    Rows that repeat a kept id are copies of it; the first in order of text stays.  Documents
    without an id are kept unless they are near another document.
    """
    return jaccard_join.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has; documents left empty by it go."""
    text = F.struct(F.col("kept_text"), F.col("n_words"), F.col("n_removed"))
    found = substring_dedup.dedup_texts(docs).select("row", text.alias("left"))
    found = found.where("left.n_removed = 0 OR left.n_removed < left.n_words")
    changed = F.col("left.n_removed") > 0

    def column(name: str):
        old = F.col("row").getField(name)
        if name == "text":
            return F.when(changed, F.col("left.kept_text")).otherwise(old).alias(name)
        if name == "n_chars":
            return F.when(changed, F.char_length("left.kept_text").cast("bigint")).otherwise(old).alias(name)
        return old.alias(name)

    return found.select(*[column(name) for name in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per taken copy of a document, with its copy number."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

# The near-duplicate stage needs the whole graph of similar pairs; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs

"""Corpus pipeline over ``documents``: stages of the text operators, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet and rereads it as the next stage's documents.  All but
the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outletlens.llm import decontamination, exact_dedup, near_dedup, packing, quality
from outletlens.llm.common import table
from outletlens.llm.tokens import byte_bpe_path
from outletlens.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one document stays."""
    return near_dedup.one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a test item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The boundary records of the packed sequences."""
    return packing.pack(docs, byte_bpe_path(), with_ids=False)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact), ("minhash_near_dedup", near),
          ("benchmark_decontamination", decontaminate), ("packing", pack)]

#: The classifier, the similarity join and the tokeniser have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage_{name}")
    return docs

"""The corpus pipeline: quality, near duplicates, private data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``documents`` as they came; the last
returns where each piece of each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statforge.llm import mixing, neardup, packing, privacy, quality
from statforge.llm.tables import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def feistel_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return privacy.pseudonymised(docs)


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, numbered=False)


def sum_of_squares_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("feistel pseudonyms", feistel_pseudonyms),
    ("poisson mixing", poisson_mixing),
    ("sum-of-squares packing", sum_of_squares_packing),
]

#: Classifier training and sequential packing have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs

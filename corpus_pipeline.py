"""The corpus pipeline: from raw documents to packed training sequences.

Each stage reads what the one before it kept, and writes it as Parquet. All but the last return the columns of documents.
Part of the subpackage ``foliant.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import keep, table
from foliant.llm.exact_dedup import drop_copies
from foliant.llm.mixing import mix_documents
from foliant.llm.near_dedup import drop_near_copies
from foliant.llm.packing import PackSpec, pack
from foliant.llm.quality import fit, keep_good, sample
from foliant.llm.queries import MIX, NEAR, QUALITY, graded_labels, with_domain


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is high enough; junk and toxic ones go."""
    return keep_good(docs, fit(sample(docs, graded_labels(spark, sf_dir), QUALITY), QUALITY), QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the largest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return drop_near_copies(docs, NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budget of their source pays for, once per epoch."""
    return mix_documents(with_domain(docs), MIX).drop("domain")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in a sequence."""
    return pack(docs, PackSpec())


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: A fitted model decides the first stage, which SQL cannot say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

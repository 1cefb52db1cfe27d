"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. ``run`` applies them one after the other, each written as
Parquet and read again by the next, so that a lost executor repeats one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formbook.llm.common import read
from formbook.llm.exact import without_copies
from formbook.llm.jaccard import without_similar
from formbook.llm.mixing import mixed
from formbook.llm.packing import pack
from formbook.llm.quality import good_documents
from formbook.operators.durable import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard rules and their language's certified cutoffs."""
    return good_documents(docs, read(spark, sf_dir, "labels"), stratum_col="lang")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that are equal but for the case of A-Z."""
    return without_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return without_similar(docs, width=5, least="0.8")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1, ...; a document taken twice is there twice."""
    return mixed(docs, weights=(5, 2, 1), most=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of at most 2048 tokens."""
    return pack(docs, capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned thresholds, fingerprints and packing cannot be written as SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

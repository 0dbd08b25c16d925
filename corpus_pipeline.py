"""The corpus pipeline: quality, toxicity, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame that
is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. SQL cannot state the fitted stages, so ``ORACLE_SQL`` is None; the tests hold
each stage against a brute-force version.

Defined results, at every stage: null text counts as empty; null and repeated ids are documents of their own, unless a de-duplicating stage
finds their texts alike; ties go as the operators say (exact copies keep the largest id, near copies the smallest); very long
texts are used whole; an empty table passes as an empty table; extra columns are carried along by all stages but the last, also those
named as an operator names its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvella.llm import exact_dedup, labelled, near_dedup, packing, quality, toxicity, vocabularies
from corvella.plans.storage import materialise


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit_on(docs, _labels(spark, sf_dir), labelled.fold("doc_id", 3) != 1)
    return quality.keep(docs, model, 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit_on(docs, _labels(spark, sf_dir), labelled.fold("doc_id", 5) != 0)
    return toxicity.keep(docs, model, 0)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, packed into sequences."""
    return packing.pack_documents(docs, vocabularies.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

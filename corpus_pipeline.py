"""A corpus in stages: each is one operator over all that the stage before it kept.

All stages but the last return the columns of documents; the last returns the ids of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmend.llm.common import small_batches, table, written
from gridmend.llm.learning import remainder
from gridmend.llm.minhash_dedup import drop_near_duplicates
from gridmend.llm.mixing import mix_rows
from gridmend.llm.quality_classifier import classify_filter
from gridmend.llm.quality_rules import quality_filter
from gridmend.llm.sentencepiece_viterbi import Model, encoded_and_decoded

#: Documents that are less likely than this to be of good quality go.
LEAST_QUALITY = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # learned from all labelled documents, not from those that are left: these have few bad ones
    model_docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return classify_filter(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), remainder(3) != 1, LEAST_QUALITY, model_docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mix_rows(docs, table(spark, sf_dir, "labels", "doc_id"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encoded_and_decoded(docs, Model.read())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_dedup),
    ("mixing to target weights", mixing),
    ("sentencepiece", sentencepiece),
]

#: Weighted hashes, compression and ids can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again.

    Documents without words go in the first stage, copies in the third. An empty table gives an empty result; repeated
    rows are one document. Once the result is written, common.clear(spark) deletes what the stages have written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

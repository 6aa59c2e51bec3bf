"""From raw documents to packed training sequences.

Each stage works on all that the one before kept, and its decisions take effect: rejected documents go, one
document of each group of near-duplicates stays, documents with benchmark passages go, secrets are masked, and
what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontamination, jaccard_join, packing, quality, secrets, storage
from spindrift.llm.registry import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The field over lines, MinHash and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if stage is not packing_stage:
            docs = storage.keep(docs, name)
            storage.discard(before)
    return docs

"""The corpus pipeline: language, near-duplicates, benchmark passages, packing.

Each stage takes all rows that its predecessor kept and returns the columns of documents; the last one
returns the packed pieces. Language ID drops texts that are null or without a letter; it keeps
ambiguous ones. Near-dedup keeps one document of each class: that of the least id, null ids last, and of several rows of that id the
one of least hash, so repeated rows are left once. Decontamination drops documents in which a window of ten benchmark words occurs.

Defined cases: null ids are ids like others; texts of any length are read whole; extra columns, whatever their names,
pass the first three stages unchanged and are ignored by packing; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnfield.llm import decontaminate, language_id, near_dups, packing
from cairnfield.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", identify_language), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_benchmark), ("packing", pack_sequences)]

#: Classifier, sketches and tokenizer are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

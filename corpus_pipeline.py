"""A corpus pipeline of five stages; each reads what the one before it wrote.

Defined results: rows with a null doc_id end at the language stage, as do null, empty and letterless texts; rows that repeat a
doc_id are judged each by language and toxicity, and one of them stays at near duplicates (see ``simhash``); equal texts are
one group, of which the smallest doc_id stays; extra columns pass through all stages but the last; an empty table gives an
empty result. What the stages write is deleted when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, langid, packing, simhash, toxicity
from leafmill.llm.common import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each stretch of tokens goes."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Several stages (profiles, nearest examples, least squares) are no SQL; tests/llm holds run() against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs

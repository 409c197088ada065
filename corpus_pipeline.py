"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, sources are mixed to their target weights, and what is left is shuffled into shards.

Null and empty texts pass the first three stages (they aren't toxic, are groups of their own and have no words) and leave
in the mix, which serves words; repeated rows are near duplicates, of which one stays; ties go by the smaller id; texts of any
length are judged whole; an empty table passes as one; columns of any name are carried, but for those
named like the last stage's own, which it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontamination, mixing, neardup, sharding, toxicity
from tidewright.llm.scratch import path_of
from tidewright.shared import deleted, shared_folder, tidied


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; without labels of both classes those stay whose smoothed share is below the threshold."""
    return toxicity.not_toxic(docs, spark.read.parquet(path_of(sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id; null ids come last."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; an empty benchmark removes none."""
    return decontamination.clean(docs, spark.read.parquet(path_of(sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fair queue serves them, up to three times; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled shards, written one folder each to the shared folder, read back."""
    return sharding.write_shards(sharding.external_shuffle(docs), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


STAGES = [
    ("toxicity", detoxify),
    ("near-dedup", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's input and its tables on the way are deleted once its result is written."""
    docs, before = spark.read.parquet(path_of(sf_dir, "documents")), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with tidied(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: model scores and the seeded shuffle aren't expressible in SQL
ORACLE_SQL = None

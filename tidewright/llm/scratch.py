"""Table paths, and the library's shared-folder tables under the names used here."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, numbered, prefix_sums, released, shared_folder, unused, written

TASK_BYTES = 64 << 20
BROADCAST_ROWS = 2_000_000

__all__ = ["copies_numbered", "dealt", "dropped", "numbered", "path_of", "prefix_sums", "released", "row_key", "shared_folder", "small", "unused", "written"]


def path_of(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def row_key() -> Column:
    """A 128-bit digest of a document's id and text; null and empty ones differ."""
    doc_id = F.col("doc_id").cast("string")
    parts = F.coalesce(F.concat(F.length(doc_id), F.lit(":"), doc_id), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("-"))
    return F.unhex(F.md5(F.concat(*parts)))


def copies_numbered(df: DataFrame, key: Column, size: Column, total: int, most: int, name: str) -> DataFrame:
    """``df`` with the number of each row among its equals as ``name``, so that a hash over it spreads a row however often repeated.

    Rows are told apart where those of one 64-bit ``key`` have over ``most`` of the ``total`` bytes: such rows are counted, copies being merged before
    the shuffle, and unfolded again. All others have number 0.
    """
    digest, bytes_ = unused(df, "digest"), "bytes"
    keyed = df.withColumn(digest, key)
    many = written(keyed.select(F.col(digest), size.alias(bytes_)).groupBy(digest).agg(F.sum(bytes_).alias(bytes_)).where(F.col(bytes_) > most).select(digest))
    if not many.limit(1).count():
        return df.withColumn(name, F.lit(0).cast("long"))
    many = small(many, -(-total // most))  # no more keys can have so many bytes each
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = keyed.join(many, digest, "left_anti").select(*columns, F.lit(0).cast("long").alias(name))
    counted = keyed.join(many, digest, "left_semi").groupBy(*columns).agg(F.count("*").alias(name))
    return alone.unionByName(counted.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))))


def dealt(spark: SparkSession, total: int, buckets: int) -> tuple[DataFrame, int]:
    """``bucket`` and ``task`` for buckets that hold ``total`` bytes, and how many tasks: as many as Spark's setting, more where one would get over ``TASK_BYTES``.

    Buckets are dealt to tasks in turn: ``task`` is a number whose hash partition among so many is the bucket's.
    """
    n = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)))
    numbers = spark.range(16 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).cast("long").alias("place")).agg(F.min("id").alias("task"))
    table = spark.range(buckets).select(F.col("id").alias("bucket"), (F.col("id") % n).alias("place")).join(numbers, "place", "left")
    table = table.select("bucket", F.coalesce("task", "place").alias("task"))
    return table, n


def small(table: DataFrame, rows: int) -> DataFrame:
    """A table of few columns to be broadcast if its rows are few enough."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table

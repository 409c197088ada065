"""Two-pass external shuffle into shards.

Pass 1 scatters rows by a seeded hash into buckets small enough for one task's memory; pass 2
permutes each bucket by a seeded Fisher-Yates shuffle. The buckets in their order form one shuffled
stream, dealt to the shards in turn, so that shard row counts differ by at most one
(law ``rows``).

Defined results: a null text has no bytes and CRC 0; equal rows stay rows of their own; a null id
hashes like any value; repeated rows are spread over buckets; texts of any length are one record; an empty table gives no rows; all other
columns are carried along, whatever their names, but for those named like the ones added (in any case), which are replaced by them.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import copies_numbered, dealt, path_of, prefix_sums, small, unused, written

SHARDS = 8
SEED = 20_240_501
BUCKET_BYTES = 8 << 20
ADDED = ("size", "text_crc32", "shard", "slot", "stream_pos")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of ``range(n)``: swaps from the last place down, each with a place at or below it."""
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1), dtype=np.int64) if n else np.zeros(0, np.int64)
    at = list(range(n))
    for k, j in zip(range(n - 1, -1, -1), draw.tolist(), strict=True):
        at[k], at[j] = at[j], at[k]
    return np.array(at, np.int64)


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless in the shard from 0) and ``stream_pos``."""
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in ADDED]
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = docs.select(*keep).withColumn("size", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1).withColumn("text_crc32", crc)
    total = sized.agg(F.sum("size")).first()[0] or 1
    buckets = -(-total // bucket_bytes)
    bucket, offset, copy, task = (unused(sized, c) for c in ("bucket", "offset", "copy", "task"))
    own = copies_numbered(sized, F.xxhash64("doc_id", "text_crc32"), F.col("size"), total, bucket_bytes // 8, copy)
    tagged = own.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col(copy)), F.lit(buckets)))
    counts = prefix_sums(tagged.groupBy(F.col(bucket).alias("bucket")).count(), [F.col("bucket")], {"upto": "count"})
    places, tasks = dealt(docs.sparkSession, total, buckets)
    counts = counts.join(places, "bucket")
    offsets = written(counts.select(F.col("bucket").alias(bucket), F.col("task").alias(task), (F.col("upto") - F.col("count")).cast("long").alias(offset)))
    schema = T.StructType([*sized.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("stream_pos", T.LongType())])
    names = sized.columns

    def permute(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        number, n = key[1].as_py(), group.num_rows
        # rows arrive in any order: sort by content first, so that reruns agree
        order = pa.compute.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text_crc32", "ascending"), (copy, "ascending"), ("size", "ascending")])
        group = group.take(order).take(pa.array(fisher_yates(n, seed * 1_000_003 + number)))
        at = group.column(offset).to_numpy() + np.arange(n)
        return pa.table([*[group.column(c) for c in names], pa.array((at % shards).astype(np.int32)), pa.array(at // shards), pa.array(at)], names=[*names, "shard", "slot", "stream_pos"])

    joined = tagged.join(small(offsets, buckets), bucket).repartition(tasks, F.col(task))
    return joined.groupBy(task, bucket).applyInArrow(permute, schema)


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard, each task its buckets' rows as they come, in slot order within a file; the shards read back."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path).select(*[f"`{c}`" for c in shuffled.columns])


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(path_of(sf_dir, "documents")).select("doc_id", "text")
    return external_shuffle(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

"""Tables in the cluster's shared folder that cut lineage, and running totals that spread over tasks.

Intermediate results that are read more than once are written as Parquet below the folder named
by ``spark.checkpoint.dir`` (all executors share it, so a lost executor loses nothing).
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: str | None = None
#: paths of the tables made within each open :func:`tidied`
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only where it is unset, and in local mode (tests), a folder of our own."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    return _own


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tw-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tw_path = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that no live plan reads any more."""
    for df in frames:
        if path := getattr(df, "_tw_path", None):
            deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving all tables that :func:`written` made on the way; what they were made for must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            deleted(spark, path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which a driver with little to do rarely does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Running totals in a global order: for ``{out: value_column}``, ``out`` is the sum up to and
    including the row.

    Rows are range-partitioned by ``order`` (so a hot leading key is split as long as later
    columns differ), each range is summed on its own, and the ranges' totals, one row per
    partition, are offset against one another.
    """
    part = unused(df, "part")
    total = {o: unused(df, f"total {o}") for o in sums}
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    parts = ranged.groupBy(part).agg(*[F.sum(c).alias(total[o]) for o, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select(part, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(t) for t in total.values()])
    local = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), part)  # bounded: one row per shuffle partition
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(total[o]) + F.sum(c).over(local)).alias(o) for o, c in sums.items()])


def numbered(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """Gapless numbers from 0 in a global order, without a single-task window."""
    one = unused(df, "one")
    return prefix_sums(df.withColumn(one, F.lit(1)), order, {name: one}).withColumn(name, F.col(name) - 1).drop(one)

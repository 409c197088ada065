"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a seeded random order; its virtual finish time is the
source's cumulative size divided by the source's target. A source whose target exceeds its size
queues its documents again (at most ``cap`` times). The queue is range-sorted by virtual finish
time, which interleaves the sources in proportion to their targets, its words are summed up in that order, and it is
truncated where they use up the total budget. Targets sum up to the budget at virtual time 1, so documents that start later
are left out of the queue beforehand, and one that is being served at that time is queued in two pieces.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
a source of size 0 has target 0; documents of size 0 take 0; equal rows are told apart by a row
number; equal finish times go by source, then seeded order; an empty table gives an empty mix. Extra columns pass by
:func:`fair_queue` untouched since only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import path_of, prefix_sums, row_key, unused, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source its rank, size, start in the global order, and water-filled target.

    ``sizes`` has ``source`` and ``size``. Sources are sorted by the level at which they reach
    ``cap`` times their size; the common level is the first that no later source's cap undercuts.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(per.withColumn("_one", F.lit(1)), order, {"rank": "_one", "upto": "source_size"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", (F.col("upto") - F.col("source_size")).alias("starts_at"), weight.cast("long").alias("weight"))
    ranked = written(ranked.withColumn("full", F.col("source_size") * cap).withColumn("level", F.col("full").cast("double") / F.col("weight")))
    filled = prefix_sums(ranked, [F.col("level"), F.col("rank")], {"full_upto": "full", "weight_upto": "weight"})
    total = ranked.agg(F.sum("source_size").alias("budget"), F.sum("weight").alias("weights"))
    open_level = (F.col("budget") - (F.col("full_upto") - F.col("full"))).cast("double") / (F.col("weights") - (F.col("weight_upto") - F.col("weight")))
    level = filled.crossJoin(F.broadcast(total)).select("level", "rank", open_level.alias("l")).where("l <= level").agg(F.min_by("l", F.struct("level", "rank")).alias("common"))  # one row each
    target = F.least(F.col("weight") * F.col("common"), F.col("full").cast("double"))
    return ranked.crossJoin(F.broadcast(level)).select("source", "source_size", "rank", "starts_at", F.coalesce(target, F.lit(0.0)).alias("target"))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The sorted queue: a row per document, pass and piece, and what the budget leaves of it.

    ``docs`` has ``doc_id``, ``source`` and ``size``. Result: the document's ``row`` number,
    ``pass`` (from 0), the piece's ``finish`` (virtual finish time), its ``position`` in the queue, ``words`` taken, and the
    source's columns. Rows never queued have ``pass`` null and ``words`` 0.
    """
    rows = written(
        docs.select("doc_id", "source", "size", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("key")).withColumn("row", F.monotonically_increasing_id())
    )
    sources = written(targets(rows, weights, cap))
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")]
    placed = prefix_sums(rows, order, {"upto": "size"})
    own = sources.withColumnRenamed("source", "_source")  # its size decides how Spark joins; skewed sources are split by AQE
    placed = placed.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    before = F.col("upto") - F.col("starts_at") - F.col("size")
    begun = lambda e: e * F.col("source_size") + F.col("before")
    started = F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda e: (begun(e) <= F.col("target")) & (F.col("size") > 0))
    piece = lambda e, words, finish: F.struct(e.alias("pass"), words.cast("long").alias("piece"), finish.alias("finish"))
    now = lambda e: F.least(F.col("size"), F.greatest(F.lit(0), F.round("target").cast("long") - begun(e)))  # noqa: E731  (until virtual time 1)
    end = lambda e: (begun(e) + F.col("size")).cast("double") / F.col("target")
    both = lambda e: F.array(piece(e, now(e), F.when(now(e) < F.col("size"), F.lit(1.0)).otherwise(end(e))), piece(e, F.col("size") - now(e), end(e)))
    pieces = F.filter(F.flatten(F.transform(started, both)), lambda p: p["piece"] > 0)
    queued = placed.withColumn("before", before).withColumn("_piece", F.explode_outer(pieces)).select("row", "doc_id", "source", "size", "key", "rank", "source_size", "target", "_piece.*")
    queued = queued.withColumn("_one", F.lit(1))
    sums = prefix_sums(queued, [F.col("finish").asc_nulls_last(), F.col("rank"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("row"), F.col("pass")], {"position": "_one", "through": "piece"})
    left = F.lit(budget) - (F.col("through") - F.col("piece"))
    return sums.withColumn("words", F.coalesce(F.greatest(F.lit(0), F.least(F.col("piece"), left)), F.lit(0)).cast("long")).drop("_one", "through", "piece")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per document: words taken over all passes, and its first position in the mixed order."""
    first = lambda c: F.first(c).alias(c)  # noqa: E731  (equal within a row number)
    return fair_queue(docs, weights, cap, seed).groupBy("row").agg(
        first("doc_id"), first("source"), first("size"), first("source_size"), first("target"),
        F.sum("words").cast("long").alias("taken"), F.min("position").cast("long").alias("position"),
    ).drop("row")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix of whole documents: each as often as the queue serves it, with ``docs``' columns.

    A document whose last pass is cut by the budget is served in it if at least half fits.
    Rows are told apart by a digest of id and text, so equal rows share their fate. Documents without words aren't served; columns of any
    name are carried; an empty table stays one.
    """
    row, times = unused(docs, "row"), unused(docs, "times")
    sized = docs.select(row_key().alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    passes = fair_queue(sized, weights, cap, seed).where(F.col("pass").isNotNull()).groupBy("row", "pass").agg(F.first("doc_id").alias("id"), F.first("size").alias("size"), F.sum("words").alias("words"))
    served = passes.where(F.col("words") * 2 >= F.col("size")).groupBy("row").agg(F.first("id").alias("id"), F.count("*").cast("int").alias("times"))
    served = written(served.groupBy(F.col("id").alias(row)).agg(F.max("times").alias(times)))
    out = docs.withColumn(row, row_key()).join(served, row)
    return out.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(path_of(sf_dir, "documents"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS full_size FROM ranked),
lev AS (SELECT *, CAST(full_size AS DOUBLE) / weight AS level FROM weighed),
run AS (
  SELECT *, sum(full_size) OVER o - full_size AS full_before, sum(weight) OVER o - weight AS weight_before,
         sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights
  FROM lev WINDOW o AS (ORDER BY level, rank ROWS UNBOUNDED PRECEDING)),
common AS (
  SELECT first(CAST(budget - full_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) ORDER BY level, rank) AS l FROM run
  WHERE CAST(budget - full_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) <= level),
goal AS (SELECT source, rank, source_size, least(weight * l, CAST(full_size AS DOUBLE)) AS target FROM lev, common),
placed AS (
  SELECT s.doc_id, s.size, s.key, g.rank, g.source_size, g.target, row_number() OVER () AS row,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT *, CAST(e * source_size + before AS BIGINT) AS begun FROM (SELECT *, unnest([0, 1, 2]) AS e FROM placed) WHERE size > 0 AND e * source_size + before <= target),
timed AS (SELECT *, CAST(begun + size AS DOUBLE) / target AS fin, least(size, greatest(0, CAST(round(target) AS BIGINT) - begun)) AS now FROM passes),
pieces AS (
  SELECT row, rank, key, doc_id, size, e, CASE WHEN now < size THEN 1.0::DOUBLE ELSE fin END AS finish, now AS piece FROM timed WHERE now > 0
  UNION ALL SELECT row, rank, key, doc_id, size, e, fin, size - now FROM timed WHERE now < size),
cut AS (
  SELECT row, greatest(0, least(piece, (SELECT sum(size) FROM sized) - (sum(piece) OVER (ORDER BY finish, rank, key, doc_id, size, row, e ROWS UNBOUNDED PRECEDING) - piece))) AS words FROM pieces)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(sum(c.words), 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN cut c USING (row) GROUP BY p.row, p.doc_id, p.size, p.source_size, p.target
"""

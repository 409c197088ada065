"""Near-duplicate groups by HyperMinHash.

Each document's set of three-word shingles becomes 256 registers of 16 bits, the leading-zero count
of the smallest hash in the register's bucket and the ten bits that follow. Documents with equal
sets are one class from there on. Bands of registers (folded to 8 bits) propose pairs of classes, the
collision-corrected Jaccard estimate sorts out most, and full sets, compared word by word, confirm the rest. Words are hashed under a
key drawn for each run, so texts can't be made to collide. For the bands alone, empty registers are filled from
others in an order fixed for each; else short texts with one shingle in common would share every band that it fills alone.

A bucket of a band is never expanded into all its pairs. First the estimate is made of its members and the
bucket's least class. Likely pairs merge most buckets into one cluster; where a
bucket still has several, every class outside its largest cluster is estimated against the classes of other
clusters, in cells of at most ``BLOCK`` by ``BLOCK`` classes spread over tasks, which merge clusters as they go. So every likely pair that
shares a bucket is in one cluster.

The full sets of a cluster meet in cells of two blocks of about ``CHUNK`` shingles, where all that are not linked already
are compared by an index of their shingles.

Defined results: null and empty texts have no shingles and are groups of their own; one or two
words are one shingle; repeated rows are linked; a null id never is a group's least unless all are
null; empty tables give no rows. Only ``doc_id`` and ``text`` are read by :func:`groups`;
:func:`one_of_each` carries all columns.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordblocks as wb
from .components import components
from .scratch import dropped, path_of, released, row_key, unused, written

SHINGLE = 3
SIMILARITY = 85  # per cent
REGISTERS = 256
MANTISSA = 10
ROWS = 6
BANDS = REGISTERS // ROWS
#: a pair is checked unless its estimate is so many standard errors below the threshold
SLACK = 5.0
#: expected share of equal registers among unrelated sets, times 2^MANTISSA
COLLISION = 0.169919487159739
BLOCK = 2048
#: shingles of a block of full sets
CHUNK = 800_000
#: the registers that each empty one is filled from, the first that isn't empty
_SOURCES = np.random.RandomState(8).rand(REGISTERS, REGISTERS).argsort(0)


def _hashed(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text's word hashes, in their order."""
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        a, b, c = (np.uint64(k) for k in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F))
        if len(h) == 1:
            return wb.mix(h * a + np.uint64(1))
        if len(h) == 2:
            return wb.mix(h[:1] * a + h[1:] * b + np.uint64(2))
        return wb.mix(h[:-2] * a + h[1:-1] * b + h[2:] * c)


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    s = _hashed(h)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def text_sets(column: pa.Array, key: int = 0) -> Iterator[np.ndarray]:
    buf, offs = wb.raw(column)
    starts, ends, ptr = wb.spans(buf, offs, wb.SPACED)
    h = wb.hashes(buf, starts, ends, key)
    p = ptr.tolist()
    for a, b in zip(p, p[1:], strict=False):
        yield shingles(h[a:b])


class Full(NamedTuple):
    """A text's set with its words: sorted distinct shingle hashes, the first word of each, and the words' places in the bytes."""

    hashes: np.ndarray
    first: np.ndarray
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def full_sets(column: pa.Array, key: int = 0) -> Iterator[Full]:
    buf, offs = wb.raw(column)
    starts, ends, ptr = wb.spans(buf, offs, wb.SPACED)
    h, p, o = wb.hashes(buf, starts, ends, key), ptr.tolist(), offs.tolist()
    for k, (a, b) in enumerate(zip(p, p[1:], strict=False)):
        s, first = np.unique(_hashed(h[a:b]), return_index=True)
        yield Full(s, first, wb.LOWER[buf[o[k] : o[k + 1]]], starts[a:b] - o[k], ends[a:b] - o[k])


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: 0 if the bucket is empty, else 1 + leading zeros, mantissa."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(s):
        bucket = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        v = (s[first] << np.uint64(8)) | np.uint64(0xFF)  # 56 bits, left-aligned; never zero
        lz = _leading_zeros(v)
        mantissa = (v << lz.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = (lz << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


def _leading_zeros(v: np.ndarray) -> np.ndarray:
    lz = np.zeros(len(v), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        small = v < (np.uint64(1) << np.uint64(64 - s))
        lz[small] += s
        v = np.where(small, v << np.uint64(s), v)
    return lz


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the registers each rests on."""
    used = ((x | y) != 0).sum(-1)
    same = ((x == y) & (x != 0)).sum(-1)
    return np.maximum(0, same - used * COLLISION / 2**MANTISSA) / np.maximum(used, 1), used


def likely(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    at = SIMILARITY / 100
    j, used = estimate(x, y)
    return j >= at - SLACK * np.sqrt(at * (1 - at) / np.maximum(used, 1))


def folded(sig: np.ndarray) -> np.ndarray:
    """Registers hashed to 8 bits, 0 still empty, for comparing within buckets."""
    return np.where(sig == 0, 0, (sig.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24)) % 255 + 1).astype(np.uint8)


def filled(x: np.ndarray) -> np.ndarray:
    """Rows of registers with others in place of the empty ones: two sets' agree as often as their non-empty ones do."""
    out = x.copy()
    row, at = np.nonzero(x == 0)
    for source in _SOURCES:
        if not len(row):
            break
        v = x[row, source[at]]
        out[row, at] = v
        row, at = row[v == 0], at[v == 0]
    return out


def likely_folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As :func:`likely` on folded registers, of which unrelated ones agree by chance in 1 of 255."""
    at = SIMILARITY / 100
    used = np.maximum(((x | y) != 0).sum(-1), 1)
    same = ((x == y) & (x != 0)).sum(-1)
    return same - used * (COLLISION / 2**MANTISSA + 1 / 255) >= used * (at - SLACK * np.sqrt(at * (1 - at) / used))


def linked(a: Full, b: Full) -> bool:
    """The definition, on full sets: shingles of equal hashes are compared word by word."""
    if not len(a.hashes) or not len(b.hashes):
        return False
    enough = lambda both: 100 * both >= SIMILARITY * (len(a.hashes) + len(b.hashes) - both)
    small, large = (a, b) if len(a.hashes) <= len(b.hashes) else (b, a)
    k = np.minimum(np.searchsorted(large.hashes, small.hashes), len(large.hashes) - 1)
    both = np.flatnonzero(large.hashes[k] == small.hashes)
    if not enough(len(both)):
        return False
    width = min(SHINGLE, len(small.starts))
    if width != min(SHINGLE, len(large.starts)):
        return False
    one = (small.first[both][:, None] + np.arange(width)).ravel()
    two = (large.first[k[both]][:, None] + np.arange(width)).ravel()
    same = wb.equal(small.low, small.starts[one], small.ends[one], large.low, large.starts[two], large.ends[two])
    return enough(int(same.reshape(-1, width).all(1).sum()))


def sketch(docs: DataFrame, secret: int = 0) -> DataFrame:
    """Per document: ``doc_id``, ``n`` (set size), ``cls`` (128-bit digest of its set), ``key`` of the row, ``sig``, ``mini``, ``dense`` (filled ``mini``)."""
    wide = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), row_key().alias("key"))
    id_type = wide.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, limit=1 << 21):
            n, cls, sig = [], [], []
            for s in text_sets(block.column(1), secret):
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(registers(s))
            mini = folded(np.array(sig))
            rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.record_batch(
                [block.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), block.column(2), rows(sig), rows(mini), rows(filled(mini))],
                names=["doc_id", "n", "cls", "key", "sig", "mini", "dense"],
            )

    return wide.mapInArrow(run, f"doc_id {id_type}, n long, cls binary, key binary, sig binary, mini binary, dense binary")


def _bands(classes: DataFrame) -> DataFrame:
    """``cls`` and ``band``, of which the six lowest bits are the band's number, of the classes large enough to be linked to another."""
    one = lambda i: F.substring("dense", 1 + i * ROWS, ROWS)
    keys = F.array(*[F.shiftleft(F.xxhash64(F.lit(i), one(i)), 6).bitwiseOR(F.lit(i)) for i in range(BANDS)])
    able = classes.where(F.col("n") * 100 >= SIMILARITY * (F.col("n") + 1))
    return able.select("cls", F.explode(keys).alias("band"))


def _minis(column: pa.ChunkedArray) -> np.ndarray:
    return wb.raw(column.combine_chunks())[0].reshape(-1, REGISTERS)


def _sigs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    buf, _ = wb.raw(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return buf.view(np.uint16).reshape(-1, REGISTERS) if buf.flags["C_CONTIGUOUS"] and not buf.ctypes.data % 2 else np.frombuffer(buf.tobytes(), np.uint16).reshape(-1, REGISTERS)


def _similar_sizes(a: str, b: str) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def _likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that the estimate doesn't rule out."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    sizes = lambda s: side(s).drop(f"sig_{s}")
    near = pairs.join(sizes("a"), "a").join(side("b"), "b").where(_similar_sizes("n_a", "n_b")).join(side("a").drop("n_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(likely(_sigs(batch.column(2)), _sigs(batch.column(3))))
                yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return near.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _across(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely pairs (a, b) that join all clusters of a bucket with a likely pair between them: its lesser clusters against all, in cells.

    ``placed`` has ``band``, ``cls`` and ``root``, its cluster's. Of buckets of two the pair has been estimated.
    """
    per = placed.groupBy("band", "root").agg(F.count("*").alias("c"))
    mixed = per.groupBy("band").agg(F.sum("c").alias("members"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1 and members > 2")
    mixed = mixed.select("band", F.col("most.root").alias("main"), F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"), F.ceil((F.col("members") - F.col("most.c")) / BLOCK).cast("long").alias("parts"))
    full = placed.join(mixed, "band").join(classes.select("cls", "n", "mini"), "cls")
    full = full.withColumn("minor", F.col("root") != F.col("main")).withColumn("at", F.xxhash64("cls"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("band", "block", "part", "lesser", "cls", "root", "n", "mini")
    held = full.withColumn("block", F.pmod("at", "blocks")).withColumn("part", each("parts")).withColumn("lesser", F.lit(False)).select(*columns)
    sent = full.where("minor").withColumn("part", F.pmod("at", "parts")).withColumn("block", each("blocks")).withColumn("lesser", F.lit(True)).select(*columns)

    def compare(_key: tuple[pa.Scalar, ...], g: pa.Table) -> pa.Table:
        lesser, n, sig = g.column("lesser").to_numpy(), g.column("n").to_numpy(), _minis(g.column("mini"))
        names = g.column("cls")
        label = g.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        inner = np.flatnonzero(~lesser)
        inner = inner[np.argsort(n[inner], kind="stable")]
        sizes = n[inner]
        a, b = [], []
        for i in np.flatnonzero(lesser).tolist():
            low = int(np.searchsorted(sizes * 100, n[i] * SIMILARITY))
            high = int(np.searchsorted(sizes * SIMILARITY, n[i] * 100, "right"))
            other = inner[low:high][label[inner[low:high]] != label[i]]
            if len(other):
                other = other[likely_folded(sig[other], sig[i][None, :])]
            for j in other.tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    a.append(i)
                    b.append(j)
        return pa.table([names.take(pa.array(a, pa.int64())), names.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return held.unionByName(sent).groupBy("band", "block", "part").applyInArrow(compare, "a binary, b binary")


def joined(sets: list[Full]) -> list[tuple[int, int]]:
    """Linked pairs that connect all sets which links connect.

    Every set outside the largest component is counted against all, by an index of the shingles; pairs linked by their hashes are compared word by word
    unless other links connect them already.
    """
    size = np.array([len(s.hashes) for s in sets])
    ptr = np.concatenate([[0], np.cumsum(size)])
    whole = np.concatenate([s.hashes for s in sets])
    order = np.argsort(whole, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    first = np.ones(len(whole), bool)
    first[1:] = whole[order[1:]] != whole[order[:-1]]
    begin = np.append(np.flatnonzero(first), len(whole))
    term = np.empty(len(whole), np.int64)
    term[order] = np.cumsum(first) - 1
    del whole, order, first
    label, found = np.arange(len(sets)), []
    todo = np.ones(len(sets), bool)
    while (rest := np.flatnonzero(todo & (label != np.bincount(label).argmax()))).size:
        i = int(rest[0])
        todo[i] = False
        t = term[ptr[i] : ptr[i + 1]]
        n = begin[t + 1] - begin[t]
        t, n = t[n > 1], n[n > 1]
        at = np.repeat(begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= SIMILARITY * (size[i] + size - both)) & (label != label[i])).tolist():
            if label[j] != label[i] and linked(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def _links(clusters: DataFrame, classes: DataFrame, docs: DataFrame, secret: int) -> DataFrame:
    """Linked pairs (a, b) of classes, on full sets, that connect whatever is linked within a cluster; ``clusters`` has ``node`` and ``root``."""
    sized = clusters.join(classes.select(F.col("cls").alias("node"), "n", "key"), "node")
    needed = F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / BLOCK)).cast("long")
    cells = sized.join(sized.groupBy("root").agg(F.least(needed, F.count("*")).alias("blocks")), "root").withColumn("at", F.pmod(F.xxhash64("node"), "blocks"))
    cells = cells.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("at <> to or blocks = 1")
    needs = cells.select("root", F.least("at", "to").alias("one"), F.greatest("at", "to").alias("two"), F.col("node").alias("cls"), "key")
    texts = docs.select(row_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.join(sized.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    rows = texts.join(needs, "key").select("root", "one", "two", "cls", "text")

    def check(_key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        names, sets = group.column("cls"), []
        for chunk in group.column("text").chunks:
            for block in wb.blocks([pa.record_batch([chunk], names=["text"])]):
                sets.extend(full_sets(block.column(0), secret))
        a, b = zip(*found, strict=True) if (found := joined(sets)) else ((), ())
        return pa.table([names.take(pa.array(a, pa.int64())), names.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return rows.groupBy("root", "one", "two").applyInArrow(check, "a binary, b binary")


def groups(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, the ``key`` of its row, and its ``group`` (null without shingles)."""
    wb.small_batches(docs.sparkSession)
    secret = secrets.randbits(64)
    sketches = written(sketch(docs, secret))
    classes = written(
        sketches.where("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "key")).alias("rep"), F.first("sig").alias("sig"), F.first("mini").alias("mini"), F.first("dense").alias("dense")
        ).select("cls", "least_id", "n", F.col("rep.key").alias("key"), "sig", "mini", "dense")
    )
    plain = written(sketches.drop("sig", "mini", "dense"))
    dropped(sketches)
    bands = _bands(classes)
    least = bands.groupBy("band").agg(F.min("cls").alias("a"), F.count("*").alias("members")).where("members > 1").drop("members")
    shared = written(bands.join(least, "band"))
    released(docs.sparkSession)
    stars = written(_likely_pairs(shared.where("cls <> a").select("a", F.col("cls").alias("b")).distinct(), classes))
    clusters = written(components(stars))
    placed = written(shared.select("band", "cls").join(clusters.withColumnRenamed("node", "cls"), "cls", "left").select("band", "cls", F.coalesce("root", "cls").alias("root")))
    dropped(shared)
    released(docs.sparkSession)
    rest = written(_across(placed, classes))
    dropped(placed)
    if rest.limit(1).count():
        dropped(clusters)
        clusters = written(components(stars.unionByName(rest)))
    released(docs.sparkSession)
    links = written(_links(clusters, classes, docs, secret))
    released(docs.sparkSession)
    roots = written(components(links))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least_id", F.coalesce("root", "cls").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(ids, "root").select("cls", "component_id", F.col("root").alias("group"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = plain.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "key", "group")
    result = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    result = written(result)
    released(docs.sparkSession)
    dropped(plain, classes, stars, clusters, links, roots, rest)
    return result


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, its least id; repeated rows are one row.

    Rows that differ in other columns than id and text only are told apart by those: the least as JSON stays. Nulls and empty texts are groups
    of their own; columns of any name are carried; an empty table stays one.
    """
    kept = groups(docs).where("kept").select("key", "group", "n_shingles")
    once = kept.where("n_shingles > 0").groupBy("group").agg(F.min("key").alias("key")).select("key")
    alone = kept.where("n_shingles = 0").select("key").distinct()
    key, row = unused(docs, "key"), unused(docs, "row")
    whole = docs.select(row_key().alias(key), F.struct(*docs.columns).alias(row))
    chosen = whole.join(once.unionByName(alone).withColumnRenamed("key", key), key, "left_semi")
    rest = [F.col(row)[c] for c in docs.columns if c not in ("doc_id", "text")]
    picked = chosen.groupBy(key).agg((F.min_by(row, F.to_json(F.array(*[c.cast("string") for c in rest]))) if rest else F.first(row)).alias(row))
    return picked.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(path_of(sf_dir, "documents")).select("doc_id", "text")
    return groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


def brute_force(docs: list[tuple[object, str | None]]) -> list[tuple[object, int, object, bool]]:
    """The same by comparing all pairs, for tests."""
    sets = []
    for _, text in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for s in "\t\n\v\f\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    by: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for own in by.values():
        for p, i in enumerate(own):
            for j in own[:p]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                        root[find(i)] = find(j)
    least: dict[int, object] = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)]

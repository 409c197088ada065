"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into shards of bounded bytes. A shard is one row of the index: all its tokens (as 64-bit hashes
under a key drawn for the index) in order, for each its postings (word numbers in the shard, delta-coded) and in how many documents it is,
and the shard's documents. So the index is partitioned by document and no posting list ever has to be
shuffled or held whole, however common its token. A phrase is looked up in a shard by intersecting the
offset-adjusted lists of its tokens from the corpus-rarest on; a proximity match is a run of words within one document, of bounded length and beginning with one of the
phrase's tokens, that holds all of them in any order.

The test items are read in blocks of about ``ITEM_BYTES`` bytes of text, which bounds what the driver and a task hold of them.

Defined results: a null or empty text has no words; an item without words is skipped; an item without id hits words but isn't listed; an item with
fewer words than the window is one window; repeated items count once, repeated rows on their own; empty tables
give no hits; documents and items of any length are read whole; columns other than those named are ignored (:func:`contamination`) or carried
(:func:`clean`), whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordblocks as wb
from .scratch import path_of, row_key, unused, written

WINDOW = 10
#: a window's words in any order within so many words of a document are a proximity match
PROXIMITY = 20
SHARD_BYTES = 4 << 20
ITEM_BYTES = 4 << 20
#: places of windows' rarest tokens that are looked at in one go
PLACES = 1 << 19


def varint(values: np.ndarray) -> bytes:
    """LEB128 of non-negative integers."""
    return _encoded(values)[0]


def _encoded(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """LEB128 of all values, and the bytes each takes."""
    v = values.astype(np.uint64)
    width = np.maximum(1, (64 - _leading(v) + 6) // 7)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - width
    for k in range(int(width.max()) if len(v) else 0):
        live = width > k
        part = (v[live] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at[live] + k] = part | np.where(width[live] > k + 1, 0x80, 0).astype(np.uint64)
    return out.tobytes(), width


def _leading(v: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(v), np.int64)
    w = v.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = w >= np.uint64(1) << np.uint64(s)
        bits[big] += s
        w[big] >>= np.uint64(s)
    return 64 - bits - (w > 0)


def unvarint(data: bytes | np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(first, last - first + 1)) * 7
    return np.add.reduceat((b & 0x7F).astype(np.int64) << shift, first)


def tokens(text: str | None) -> list[str]:
    """The words of one text, A-Z lower-cased."""
    buf = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    s, e, _ = wb.spans(buf, np.array([0, len(buf)]), wb.ALNUM)
    return wb.words(buf, s, e)


class Plan(NamedTuple):
    """Distinct windows of a block of items: their tokens as numbers of ``terms`` (sorted hashes), -1 past a short window's end."""

    terms: np.ndarray
    tokens: np.ndarray
    offsets: np.ndarray  # of the same tokens
    lengths: np.ndarray
    owner: np.ndarray  # per window and item that has it: the item's number,
    window: np.ndarray  # and the window's
    items: list[str | None]


def windows_of(items: list[tuple[str | None, str | None]], window: int, key: int) -> Plan:
    """The windows of items, their tokens in the items' order."""
    buf, offs = wb.raw(pa.array([t or "" for _, t in items], pa.string()))
    starts, ends, ptr = wb.spans(buf, offs, wb.ALNUM)
    terms, number = np.unique(wb.hashes(buf, starts, ends, key), return_inverse=True)
    n = np.diff(ptr)
    count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    begin = ptr[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n[owner], window)
    at = begin[:, None] + np.arange(window)
    tokens = np.where(np.arange(window) < length[:, None], np.append(number, -1)[np.minimum(at, len(number))], -1).astype(np.int32)
    if not len(tokens):
        return Plan(terms, tokens, tokens, length, owner, owner, [i for i, _ in items])
    whole, first, same = np.unique(np.ascontiguousarray(tokens).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
    offsets = np.broadcast_to(np.arange(window, dtype=np.int32), tokens.shape)
    return Plan(terms, tokens[first], offsets[first], length[first], owner, same.ravel(), [i for i, _ in items])


def ordered(plan: Plan, rarity: np.ndarray) -> Plan:
    """The windows whose tokens all occur, their tokens from the rarest on."""
    known = np.append(rarity, 1)[plan.tokens]  # the last is for -1
    can = (known > 0).all(1)
    order = np.argsort(np.where(plan.tokens < 0, np.iinfo(np.int64).max, known), 1, kind="stable")
    new = np.where(can, np.cumsum(can) - 1, -1)
    pairs = new[plan.window] >= 0
    take = lambda m: np.take_along_axis(m, order, 1)[can]
    return Plan(plan.terms, take(plan.tokens), take(plan.offsets), plan.lengths[can], plan.owner[pairs], new[plan.window][pairs], plan.items)


class Index(NamedTuple):
    """``rows``: the index, a row per shard; ``key``: what its tokens are hashed under."""

    rows: DataFrame
    key: int

    def documents(self) -> DataFrame:
        """``shard``, ``doc`` (position in the shard), ``doc_id`` and ``n_words`` of all documents."""
        zipped = F.posexplode(F.arrays_zip("doc_ids", "n_words"))
        return self.rows.select("shard", zipped.alias("doc", "d")).select("shard", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))

    def rarity(self, terms: np.ndarray) -> np.ndarray:
        """In how many documents each of the tokens is."""
        shared = self.rows.sparkSession.sparkContext.broadcast(terms)  # of one block of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value), np.int64)
            for b in batches:
                for have, df in zip(b.column(0), b.column(1), strict=True):
                    at = _find(np.frombuffer(have.as_buffer(), "<u8"), shared.value)
                    total[at >= 0] += np.frombuffer(df.as_buffer(), "<u4")[at[at >= 0]]
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "df"])

        out = np.zeros(len(terms), np.int64)
        for term, df in self.rows.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # at most those terms
            out[term] = df
        return out


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the sorted numbers hold the wanted ones, -1: nowhere."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def _postings(h: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """The distinct tokens of a shard in order, in how many documents each is, where its postings end, and all postings."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), b""
    at = np.argsort(h, kind="stable")
    h = h[at]
    opens = np.concatenate([[True], h[1:] != h[:-1]])
    cut = np.flatnonzero(opens)
    data, width = _encoded(np.where(opens, at, np.diff(at, prepend=0)))
    own = doc_of[at]
    df = np.add.reduceat((opens | (np.diff(own, prepend=-1) != 0)).astype(np.int64), cut)
    return h[cut], df, np.cumsum(np.add.reduceat(width, cut)), data


def build_index(docs: DataFrame, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> Index:
    """The positional index of all tokens of ``docs``, written to the shared folder.

    Rows: ``shard``; ``terms``, ``df`` and ``edges`` (binary arrays: sorted token hashes, documents of the shard that have the token, ends of its
    postings); ``postings`` (varint gaps of the sorted word numbers); ``doc_ids`` and ``n_words``, the shard's documents.
    """
    wb.small_batches(docs.sparkSession)
    key = secrets.randbits(64)
    wide = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    id_type = wide.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for block in wb.blocks(batches, limit=shard_bytes):
            buf, offs = wb.raw(block.column(1))
            starts, ends, ptr = wb.spans(buf, offs, wb.ALNUM)
            n = np.diff(ptr)
            terms, df, edges, data = _postings(wb.hashes(buf, starts, ends, key), np.repeat(np.arange(len(n)), n))
            one = lambda values, kind: pa.array([values.astype(kind).tobytes()], pa.binary())
            per = pa.array([0, len(n)], pa.int32())
            yield pa.record_batch(
                [pa.array([serial]), one(terms, "<u8"), one(df, "<u4"), one(edges, "<u4"), pa.array([data], pa.binary()), pa.ListArray.from_arrays(per, block.column(0)), pa.ListArray.from_arrays(per, pa.array(n.astype(np.int32)))],
                names=["shard", "terms", "df", "edges", "postings", "doc_ids", "n_words"],
            )
            serial += 1

    return Index(written(wide.mapInArrow(run, f"shard long, terms binary, df binary, edges binary, postings binary, doc_ids array<{id_type}>, n_words array<int>")), key)


def near(lists: list[np.ndarray], width: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Proximity: the tokens' places from which ``width`` words of the same document hold a token of every list; the rarest list first.

    Documents hold ``count`` words from ``first`` on, in order.
    """
    a = lists[0]
    d = np.searchsorted(first, a, "right") - 1
    low, high = np.maximum(first[d], a - width + 1), np.minimum(first[d] + count[d], a + width)
    for p in lists[1:]:
        some = np.searchsorted(p, high) > np.searchsorted(p, low)
        a, d, low, high = a[some], d[some], low[some], high[some]
        if not len(a):
            return a
    starts, ends = [], []
    for p in lists:
        x, y = np.searchsorted(p, low), np.searchsorted(p, a, "right")
        anchor = np.repeat(np.arange(len(a)), y - x)
        starts.append(p[x[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(y - x) - (y - x), y - x)])
        ends.append(np.minimum(starts[-1] + width, (first[d] + count[d])[anchor]))
    s, at = np.unique(np.concatenate(starts), return_index=True)
    e = np.concatenate(ends)[at]
    for p in lists:
        some = np.searchsorted(p, e) > np.searchsorted(p, s)
        s, e = s[some], e[some]
    return s


class Shard(NamedTuple):
    """Postings of a plan's tokens in one shard: ``keys`` are token number times ``reach`` plus word number, all sorted."""

    local: np.ndarray  # per term of the plan its number here, -1: not here; the last, for -1, is -2
    keys: np.ndarray
    edges: np.ndarray  # per token where its keys begin, one more at the end
    reach: int
    first: np.ndarray  # per document its first word
    count: np.ndarray


def _opened(row: dict[str, pa.Scalar], plan: Plan, margin: int) -> Shard:
    count = row["n_words"].values.to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    reach = int(count.sum()) + margin
    place = _find(np.frombuffer(row["terms"].as_buffer(), "<u8"), plan.terms)
    have = np.flatnonzero(place >= 0)
    local = np.full(len(place) + 1, -1)
    local[have] = np.arange(len(have))
    local[-1] = -2
    edges = np.concatenate([[0], np.frombuffer(row["edges"].as_buffer(), "<u4")]).astype(np.int64)
    begin, end = edges[place[have]], edges[place[have] + 1]
    data = np.frombuffer(row["postings"].as_buffer(), np.uint8)
    at = np.repeat(begin, end - begin) + np.arange(int((end - begin).sum())) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
    data = data[at]
    ends = np.concatenate([[0], np.cumsum(data < 0x80)])
    cut = ends[np.concatenate([[0], np.cumsum(end - begin)])]
    total = np.concatenate([[0], np.cumsum(unvarint(data))])
    keys = total[1:] + np.repeat(np.arange(len(have)) * reach - total[cut[:-1]], np.diff(cut))
    return Shard(local, keys, cut, reach, first, count)


def _exact(shard: Shard, tokens: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and first words of exact matches: the rarest tokens' places ``a`` intersected with the others' lists, offset-adjusted."""
    s = a - offsets[w, 0]
    some = s >= 0
    w, s = w[some], s[some]
    d = np.searchsorted(shard.first, s, "right") - 1
    some = s + lengths[w] <= shard.first[d] + shard.count[d]
    w, s = w[some], s[some]
    for j in range(1, tokens.shape[1]):
        if not len(w):
            break
        token = tokens[w, j]
        key = token * shard.reach + s + offsets[w, j]
        k = np.minimum(np.searchsorted(shard.keys, key), len(shard.keys) - 1)
        some = (shard.keys[k] == key) | (token < 0)
        w, s = w[some], s[some]
    return w, s


def _close(shard: Shard, tokens: np.ndarray, w: np.ndarray, a: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Windows with proximity matches: those with a rarest token that has all others around it are looked at closely."""
    d = np.searchsorted(shard.first, a, "right") - 1
    low, high = np.maximum(shard.first[d], a - width + 1), np.minimum(shard.first[d] + shard.count[d], a + width)
    for j in range(1, tokens.shape[1]):
        if not len(w):
            break
        base = tokens[w, j] * shard.reach
        some = (np.searchsorted(shard.keys, base + high) > np.searchsorted(shard.keys, base + low)) | (base < 0)
        w, low, high = w[some], low[some], high[some]
    for k in np.unique(w).tolist():
        lists = [shard.keys[shard.edges[t] : shard.edges[t + 1]] - t * shard.reach for t in dict.fromkeys(tokens[k].tolist()) if t >= 0]
        at = near(lists, width, shard.first, shard.count)
        if len(at):
            yield k, at


def _matches(row: dict[str, pa.Scalar], plan: Plan, width: int | None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """One shard's first words by document, and per window with matches its number and their first words: exact, and near if ``width``."""
    shard = _opened(row, plan, plan.tokens.shape[1] + (width or 0) + 1)
    tokens = shard.local[plan.tokens]
    here = np.flatnonzero((tokens != -1).all(1))
    exact, close = [], []
    size = np.diff(shard.edges)[tokens[here, 0]] if len(here) else here
    upto = np.cumsum(size)
    at = 0
    while at < len(here):  # so many places at once
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + PLACES, "right")))
        own, n = here[at:to], size[at:to]
        w = np.repeat(own, n)
        token = tokens[w, 0]
        a = shard.keys[shard.edges[token] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)] - token * shard.reach
        which, start = _exact(shard, tokens, plan.offsets, plan.lengths, w, a)
        cut = np.flatnonzero(np.diff(which, prepend=-1))
        exact += list(zip(which[cut].tolist(), np.split(start, cut[1:]), strict=True)) if len(which) else []
        if width:
            close += list(_close(shard, tokens, w, a, width))
        at = to
    return shard.first, exact, close


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def search(index: Index, phrases: list[str], proximity: int | None = None) -> DataFrame:
    """Matches of the phrases: ``doc_id``, ``phrase`` (its number), ``start`` (word of the document).

    Exact phrases, or with ``proximity`` every place of one of a phrase's tokens from which so many words of the document hold all.
    Phrases without words match nothing.
    """
    longest = max([1, *(len(tokens(p)) for p in phrases)])
    plan = windows_of(list(zip(map(str, range(len(phrases))), phrases, strict=True)), longest, index.key)
    shared = index.rows.sparkSession.sparkContext.broadcast(ordered(plan, index.rarity(plan.terms)))  # the phrases given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            for row in _rows(b):
                first, exact, close = _matches(row, plan, proximity)
                for w, at in exact if proximity is None else close:
                    d = np.searchsorted(first, at, "right") - 1
                    for owner in plan.owner[plan.window == w].tolist():
                        yield pa.record_batch([row["doc_ids"].values.take(pa.array(d)), pa.array(np.full(len(at), owner)), pa.array(at - first[d])], names=["doc_id", "phrase", "start"])

    id_type = index.rows.schema["doc_ids"].dataType.elementType.simpleString()
    return index.rows.mapInArrow(run, f"doc_id {id_type}, phrase long, start long")


def _hits(index: Index, items: list[tuple[str | None, str | None]], window: int, proximity: int) -> DataFrame:
    """Per document with matches (``shard``, ``doc``): its covered words, the items' ids, and those of proximity matches."""
    plan = windows_of(items, window, index.key)
    plan = ordered(plan, index.rarity(plan.terms))
    order = np.argsort(plan.window, kind="stable")
    cut = np.searchsorted(plan.window[order], np.arange(len(plan.lengths) + 1))
    shared = index.rows.sparkSession.sparkContext.broadcast((plan, [np.unique(plan.owner[order[a:b]]).tolist() for a, b in zip(cut, cut[1:], strict=False)]))  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, owners = shared.value
        for b in batches:
            for row in _rows(b):
                first, exact, close = _matches(row, plan, proximity)
                hits: dict[int, tuple[set[int], set[str], set[str]]] = {}
                for w, at in exact:
                    d = np.searchsorted(first, at, "right") - 1
                    for k, a in zip(d.tolist(), (at - first[d]).tolist(), strict=True):
                        words, own, _ = hits.setdefault(k, (set(), set(), set()))
                        words.update(range(a, a + int(plan.lengths[w])))
                        own.update(plan.items[o] for o in owners[w] if plan.items[o] is not None)
                for w, at in close:
                    for k in set((np.searchsorted(first, at, "right") - 1).tolist()):
                        hits.setdefault(k, (set(), set(), set()))[2].update(plan.items[o] for o in owners[w] if plan.items[o] is not None)
                strings = pa.list_(pa.string())
                yield pa.record_batch(
                    [
                        pa.array([row["shard"].as_py()] * len(hits), pa.int64()), pa.array(list(hits), pa.int32()), pa.array([sorted(w) for w, _, _ in hits.values()], pa.list_(pa.int64())),
                        pa.array([sorted(i) for _, i, _ in hits.values()], strings), pa.array([sorted(i) for _, _, i in hits.values()], strings),
                    ],
                    names=["shard", "doc", "words", "item_ids", "near_ids"],
                )

    return index.rows.mapInArrow(run, "shard long, doc int, words array<long>, item_ids array<string>, near_ids array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, proximity: int = PROXIMITY) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``item_ids`` (strings, sorted) of items with occurring windows, ``near_ids`` of those with proximity matches."""
    index = build_index(docs, shard_bytes=shard_bytes)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    table = index.documents()
    none = F.array().cast("array<string>")
    hits = None
    for k in range(parts):
        spread = _hits(index, _block(items, k, parts), window, proximity)
        hits = spread if hits is None else hits.unionByName(spread)
    if hits is None:
        return table.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"), none.alias("near_ids"))
    if parts > 1:
        hits = hits.groupBy("shard", "doc").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("words", "item_ids", "near_ids")])  # of one document
    joined = table.join(hits, ["shard", "doc"], "left")
    ids = lambda c: F.coalesce(F.array_sort(F.array_distinct(c)), none).alias(c)
    return joined.select("doc_id", "n_words", F.coalesce(F.size(F.array_distinct("words")), F.lit(0)).cast("long").alias("n_hit"), ids("item_ids"), ids("near_ids"))


def _block(items: DataFrame, k: int, parts: int) -> list[tuple[str | None, str | None]]:
    part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
    return sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; nulls and empty texts stay, as do columns of any name."""
    row = unused(docs, "row")
    numbered = docs.withColumn(row, row_key())
    found = contamination(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, window, proximity=0).where("n_hit > 0").select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(found, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(path_of(sf_dir, "documents")).select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(path_of(sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near"),
    )


def brute_force(docs: Iterable[tuple[object, str | None]], items: Iterable[tuple[object, str | None]], window: int = WINDOW, proximity: int = PROXIMITY) -> list[tuple[object, int, int, int, str, bool, int]]:
    """The same by scanning every window of every document, for tests."""
    known: dict[tuple[str, ...], set[object]] = {}
    for item, text in items:
        w = tokens(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(p) for p in known}
    out = []
    for doc, text in docs:
        w = tokens(text)
        hit, found, close = set(), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := known.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found.update(str(o) for o in own if o is not None)
        have = set(w)
        for phrase, own in known.items():
            need = set(phrase)
            if need <= have and any(w[k] in need and need <= set(w[k : k + proximity]) for k in range(len(w))):
                close.update(str(o) for o in own if o is not None)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit), len(close)))
    return out

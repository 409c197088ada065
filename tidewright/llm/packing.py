"""Token ids of a public tokenizer, packed into fixed-length sequences by best-fit decreasing.

Documents are scattered by a seeded hash into buckets small enough for one task's memory. Per bucket every
text is tokenised whole and ended by the end-of-text id; pieces longer than a sequence are cut into full
ones and a rest, so nothing is lost; pieces in decreasing length go to the open sequence with
the least room that fits, found by a segment tree over capacities. A row is one sequence: its
ids (little-endian, 16 bits or for larger vocabularies 32, padded with the end-of-text id), cumulative segment lengths, position ids that restart with
each segment, and where each segment comes from.

Defined results: a null or empty text is the end-of-text id alone; a null id is kept as null; repeated rows are packed
each and spread over buckets; texts of any length are cut, none is dropped; ties in length go by id, then text; an empty table gives no rows; only
the id and the text are read.
"""

from __future__ import annotations

import base64
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import copies_numbered, dealt, path_of, small

#: rank file of the default tokenizer; the environment names another
VOCABULARY = os.environ.get("TIDEWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
BUCKET_BYTES = 8 << 20
SEED = 5
_loaded: dict[str, tuple[object, int]] = {}


def tokenizer(path: str = VOCABULARY) -> tuple[object, int]:
    """The encoding of a rank file, and its free id, which ends texts."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    return _loaded[path]


def id_kind(largest: int) -> str:
    """The unsigned type that holds ids up to ``largest``."""
    return "<u2" if largest < 1 << 16 else "<u4"


class Rooms:
    """Open sequences by room left; a segment tree over 0..capacity finds the least room that fits."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Least room of at least ``need`` and a sequence that has it, no longer open."""
        k, count = need + self.size, self.count
        while not count[k]:
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k + (not count[2 * k])
        room = k - self.size
        which = self.open[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return room, which


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; every length is from 1 to ``capacity``."""
    rooms, bins = Rooms(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[piece]
        found = rooms.take(n)
        if found is None:
            room, which = capacity, len(bins)
            bins.append([])
        else:
            room, which = found
        bins[which].append(piece)
        if room > n:
            rooms.add(room - n, which)
    return bins


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per sequence: ``bucket``, ``seq``, ``n_tokens``, ``ids``, ``cu_seqlens``, ``positions``,
    ``doc_ids`` and ``doc_starts`` (first token of the document in each segment)."""
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 1
    buckets = -(-total // bucket_bytes)
    crc = F.crc32(F.col("text").cast("binary"))
    own = copies_numbered(plain, F.xxhash64("doc_id", crc), F.octet_length("text") + F.lit(1), total, bucket_bytes // 8, "copy")
    tagged = own.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", crc, F.col("copy")), F.lit(buckets)))
    places, tasks = dealt(docs.sparkSession, total, buckets)
    tagged = tagged.join(small(places, buckets), "bucket").repartition(tasks, "task")
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        encoding, stop = tokenizer(vocabulary)
        kind = id_kind(stop)
        group = group.take(pa.compute.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))  # reruns agree
        tokens, own, begins, lengths = [], [], [], []
        text = group.column("text")
        for i in range(group.num_rows):
            ids = np.append(encoding.encode_to_numpy(text[i].as_py(), disallowed_special=()), stop).astype(kind)
            for a in range(0, len(ids), capacity):
                tokens.append(ids[a : a + capacity])
                own.append(i)
                begins.append(a)
                lengths.append(len(tokens[-1]))
        bins = best_fit_decreasing(lengths, capacity)
        matrix = np.full((len(bins), capacity), stop, kind)
        places = np.zeros((len(bins), capacity), id_kind(capacity))
        cu, used, flat, starts, per = [], [], [], [], [0]
        for k, pieces in enumerate(bins):
            at, edges = 0, [0]
            for p in pieces:
                n = lengths[p]
                matrix[k, at : at + n] = tokens[p]
                places[k, at : at + n] = np.arange(n)
                at += n
                edges.append(at)
            places[k, at:] = np.arange(capacity - at)
            cu.append(edges)
            used.append(at)
            flat += [own[p] for p in pieces]
            starts += [begins[p] for p in pieces]
            per.append(len(flat))
        ids = group.column("doc_id").combine_chunks().take(pa.array(flat, pa.int64()))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(per, pa.int32()), values)
        n = len(bins)
        return pa.table(
            [
                pa.array(np.full(n, key[1].as_py())), pa.array(np.arange(n)), pa.array(used, pa.int32()), pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array(cu, pa.list_(pa.int32())),
                pa.array([r.tobytes() for r in places], pa.binary()), lists(ids), lists(pa.array(starts, pa.int64())),
            ],
            names=["bucket", "seq", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "doc_starts"],
        )

    return tagged.groupBy("task", "bucket").applyInArrow(
        run, f"bucket long, seq long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{id_type}>, doc_starts array<long>"
    )


def write_matrices(packed: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One ``.npy`` matrix of ids per bucket below ``path`` (a folder all executors share, of any file system Arrow knows), and per file its name and rows.

    A file is written under another name and then renamed, so a repeated or lost task leaves it whole.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        system, root = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        rows = group.sort_by("seq").column("ids").to_pylist()
        ids = np.frombuffer(b"".join(rows), f"<u{len(rows[0]) // capacity}").reshape(-1, capacity)
        system.create_dir(root, recursive=True)
        name = f"{root.rstrip('/')}/ids-{key[0].as_py():08d}.npy"
        part = f"{name}.{uuid.uuid4().hex}.part"
        data = io.BytesIO()
        np.save(data, ids)
        with system.open_output_stream(part) as f:
            f.write(data.getvalue())
        system.move(part, name)
        return pa.table([pa.array([name]), pa.array([len(ids)])], names=["file", "sequences"])

    return packed.select("bucket", "seq", "ids").groupBy("bucket").applyInArrow(run, "file string, sequences long")


def unpacked(rows: Iterator[dict], vocabulary: str = VOCABULARY) -> dict[object, bytes]:
    """The documents' bytes from packed rows with distinct ids, for round trips."""
    encoding, stop = tokenizer(vocabulary)
    parts: dict[object, list[tuple[int, np.ndarray]]] = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], id_kind(stop))
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(doc, []).append((start, ids[a:b]))
    whole = {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for d, p in parts.items()}
    return {d: encoding.decode_bytes([t for t in ids.tolist() if t != stop]) for d, ids in whole.items()}


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(path_of(sf_dir, "documents")))

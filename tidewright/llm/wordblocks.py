"""Words of Arrow text columns, found and hashed on the raw UTF-8 bytes with numpy.

A 256-entry table says which bytes belong to words; since every non-ASCII byte is >= 0x80 the
byte view agrees with the code-point view for the classes used here.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 4 << 20
#: words hashed at once; the arrays stay in cache
HASH_WORDS = 1 << 15

#: not ASCII white space
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and everything non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: words of more bytes are hashed one by one
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def trimmed() -> None:
    """Give freed memory back to the system, which allocators otherwise keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have texts sent to Python in batches of few rows, so that a worker holds few texts at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        trimmed()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and per row the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = table[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = offs[:-1][offs[:-1] < n]
    first[edge] = m[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = m[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def eights(low: np.ndarray) -> np.ndarray:
    """For every byte it and the seven after it as one number (zeros past the end)."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    return np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased, eight bytes after eight mixed in.

    Whoever doesn't know the ``key`` can't make words that collide.
    """
    out = np.empty(len(starts), np.uint64)
    low = LOWER[buf]
    eight = eights(low)
    seed = np.uint64((key ^ 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), HASH_WORDS):
            s, n = starts[at : at + HASH_WORDS], ends[at : at + HASH_WORDS] - starts[at : at + HASH_WORDS]
            h = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed)
            h = mix(h ^ (eight[s] & _MASKS[np.minimum(n, 8)]))
            live = np.flatnonzero((n > 8) & (n <= LONG_WORD))
            done = 8
            while len(live):
                h[live] = mix(h[live] ^ (eight[s[live] + done] & _MASKS[np.minimum(n[live] - done, 8)]))
                done += 8
                live = live[n[live] > done]
            for k in np.flatnonzero(n > LONG_WORD).tolist():
                h[k] = int.from_bytes(hashlib.blake2b(low[s[k] : s[k] + n[k]].tobytes(), digest_size=8, key=(key & (1 << 64) - 1).to_bytes(8, "little")).digest(), "little")
            out[at : at + HASH_WORDS] = h
    return out


def equal(low: np.ndarray, s: np.ndarray, e: np.ndarray, low2: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Which words of one lower-cased text are, byte by byte, those at the same places of another list."""
    n = e - s
    same = n == e2 - s2
    one, two = eights(low), eights(low2)
    live, done = np.flatnonzero(same & (n <= LONG_WORD)), 0
    while len(live):
        mask = _MASKS[np.minimum(n[live] - done, 8)]
        differ = (one[s[live] + done] ^ two[s2[live] + done]) & mask != 0
        same[live[differ]] = False
        done += 8
        live = live[~differ & (n[live] > done)]
    for k in np.flatnonzero(same & (n > LONG_WORD)).tolist():
        same[k] = np.array_equal(low[s[k] : e[k]], low2[s2[k] : e2[k]])
    return same


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words themselves, A-Z lower-cased."""
    low = LOWER[buf].tobytes()
    return [low[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]

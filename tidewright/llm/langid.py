"""Language of mixed-language text: script ranges, word scores, and Viterbi with a switching penalty.

The script of a word narrows the languages it may have to those seen in that script while
learning. Within them a word scores by hashed character trigrams, its ending and itself (naive Bayes,
clipped so that no single word decides). Viterbi over a document's words with a fixed
penalty per switch labels spans; the document's language is the one whose spans hold most words, its
score their share.

Every learned language is a state of every document. Learning uses at most ``sample`` rows (per language an equal share, and ``LEAST`` at least), chosen
by a hash of the id among those with texts of up to ``chars`` characters, both parameters of :func:`train`; every row is predicted whole.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything where
nothing could be learned; ties go to the language first by code point; repeated rows get equal predictions;
an empty table gives no rows; only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordblocks as wb
from .scratch import path_of

SAMPLE = 4000
LEAST = 20
SAMPLE_CHARS = 20_000
GRAM_BITS, WORD_BITS = 15, 17
PENALTY = 6.0
CLIP = 4.0
CHUNK = 64
#: bytes that the scores from every state to every state of all chunks may take; chunks grow with the states
ACROSS_BYTES = 64 << 20
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: first code points of runs of one script; a word belongs to the script of its first character
SCRIPTS = (
    (0x00, "latin"), (0x250, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"),
    (0x780, "thaana"), (0x7C0, "other"), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"),
    (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
_NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS])
_OF = np.array([_NAMES.index(s) for _, s in SCRIPTS])


def scripts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number of each word, from its first character."""
    b = [np.concatenate([buf, np.zeros(4, np.uint8)])[starts + k].astype(np.int64) for k in range(4)]
    code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)))
    return _OF[np.searchsorted(_FIRST, code, "right") - 1]


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the capitals from U+00C0 to U+00DE."""
    low = wb.LOWER[buf]
    accented = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[1:][accented] += 32
    return low


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte the bucket of the trigram that ends there (words apart), per word those of its ending and of itself."""
    text = np.where(LETTERS[low], low, 0).astype(np.uint32)
    one, two = np.zeros_like(text), np.zeros_like(text)
    one[1:], two[2:] = text[:-1], text[:-2]
    one[starts] = 0
    two[starts] = 0
    inside = starts[ends - starts > 1] + 1
    two[inside] = 0
    tri = (text | one << np.uint32(8) | two << np.uint32(16)) * np.uint32(0x9E3779B1)
    tri = (tri >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    pad = np.concatenate([low, np.zeros(1, np.uint8)]).astype(np.uint32)
    n = ends - starts
    tail = sum(np.where(n > k, pad[np.maximum(ends - 1 - k, 0)], np.uint32(0)) << np.uint32(8 * k) for k in range(3))
    tail = (((tail | np.uint32(1 << 25)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    word = (wb.hashes(low, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return tri, tail, word


def learn(texts: list[str], langs: list[str]) -> dict[str, object] | None:
    names = sorted(set(langs))
    if not names:
        return None
    g, w, s = (np.full((n, len(names)), 0.0) for n in (1 << GRAM_BITS, 1 << WORD_BITS, len(_NAMES)))
    for text, lang in zip(texts, langs, strict=True):
        buf, offs = wb.raw(pa.array([text]))
        starts, ends, _ = wb.spans(buf, offs, LETTERS)
        if len(starts):
            k = names.index(lang)
            low = folded(buf)
            tri, tail, word = grams(low, starts, ends)
            mine = LETTERS[low]
            g[:, k] += np.bincount(tri[mine], minlength=len(g)) + np.bincount(tail, minlength=len(g))
            w[:, k] += np.bincount(word, minlength=len(w))
            s[:, k] += np.bincount(scripts(buf, starts), minlength=len(s))
    odds = lambda c, a: np.log((c + a) / (c.sum(0) + a * len(c)))
    centred = lambda t: (t - t.mean(1, keepdims=True)).astype(np.float32)
    share = s / np.maximum(1, s.sum(0))
    return {"names": names, "gram": centred(odds(g, 0.5)), "word": centred(odds(w, 0.5)), "script": share > 0.01}


def word_scores(model: dict[str, object], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = folded(buf)
    tri, tail, word = grams(low, starts, ends)
    total = np.zeros((len(starts), len(model["names"])), np.float32)
    inside = LETTERS[low]
    for k in range(total.shape[1]):
        table = np.ascontiguousarray(model["gram"][:, k])
        run = np.zeros(len(low) + 1)
        np.cumsum(table[tri] * inside, out=run[1:], dtype=float)
        total[:, k] = run[ends] - run[starts] + table[tail] + model["word"][:, k][word]
    np.clip(total, -CLIP, CLIP, out=total)
    allowed = model["script"][scripts(buf, starts)]
    some = allowed.any(1)
    if not allowed.all():
        total[~some] = 0
        total[some] = np.where(allowed[some], total[some], -2 * CLIP)
    return total


def viterbi(scores: np.ndarray, ptr: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best state of every word; rows ``ptr[i]:ptr[i+1]`` are one document.

    Documents are cut into chunks that are worked through side by side: first each chunk's scores
    from every state to every state, then the chunks of a document one after the other, then the
    paths within all chunks. The result is that of one pass over each document.
    """
    n, states = scores.shape
    chunk = max(CHUNK, -(-4 * n * states * states // ACROSS_BYTES))
    length = np.diff(ptr)
    per = -(-length // chunk)
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(length)), per)
    place = np.arange(total) - first[doc]
    begin = ptr[doc] + place * chunk
    size = np.minimum(chunk, ptr[doc + 1] - begin)
    padded = np.concatenate([scores, np.zeros((1, states), scores.dtype)])
    at = lambda t, c=slice(None): padded[np.where(t < size[c], begin[c] + t, n)]
    width = int(size.max())
    passed = np.flatnonzero(place < per[doc] - 1)  # whole chunks that others follow
    row = np.empty(total, np.int64)
    row[passed] = np.arange(len(passed))
    across = np.where(np.eye(states, dtype=bool), np.float32(0), np.float32(-penalty))[None].repeat(len(passed), 0)
    for t in range(chunk if len(passed) else 0):
        np.maximum(across, across.max(2, keepdims=True) - np.float32(penalty), out=across)
        across += at(t, passed)[:, None, :]
    enter = np.zeros((total, states), np.float32)
    most = int(per.max())
    for k in range(most - 1):
        docs = np.flatnonzero(per > k + 1)
        c = first[docs] + k
        v = (enter[c][:, :, None] + across[row[c]]).max(1)
        enter[c + 1] = v - v.max(1, keepdims=True)
    number = np.min_scalar_type(states)
    back = np.empty((width, total, states), number)
    v = enter
    own = np.arange(states, dtype=number)[None]
    for t in range(width):
        top = v.argmax(1)
        best = v[np.arange(total), top] - np.float32(penalty)
        switch = v < best[:, None]
        back[t] = np.where(switch, top[:, None].astype(number), own)
        v = np.maximum(v, best[:, None]) + at(t)
    rows = np.arange(total)
    came = np.broadcast_to(own, (total, states)).astype(np.int64)
    for t in range(width - 1, -1, -1):
        came = back[t][rows[:, None], came].astype(np.int64)
    last = v.argmax(1)
    for k in range(most - 1, 0, -1):
        docs = np.flatnonzero(per > k)
        c = first[docs] + k
        last[c - 1] = came[c, last[c]]
    out = np.empty(n + 1, np.int64)
    state = last
    for t in range(width - 1, -1, -1):
        out[np.where(t < size, begin + t, n)] = state
        state = back[t][rows, state].astype(np.int64)
    return out[:n]


def labelled(model: dict[str, object], column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (bytes), first word per row, label per word, and the bytes."""
    buf, offs = wb.raw(column)
    starts, ends, ptr = wb.spans(buf, offs, LETTERS)
    s = word_scores(model, buf, starts, ends)
    return starts, ends, ptr, viterbi(s, ptr), buf


def predict(model: dict[str, object] | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    rows = len(column)
    if model is None:
        return ["und"] * rows, np.zeros(rows)
    starts, ends, ptr, label, buf = labelled(model, column)
    names = model["names"]
    doc = np.repeat(np.arange(rows), np.diff(ptr))
    votes = np.bincount(doc * len(names) + label, minlength=rows * len(names)).reshape(rows, len(names))
    best = votes.argmax(1)
    words = np.diff(ptr)
    score = votes[np.arange(rows), best] / np.maximum(1, words)
    lang = [names[k] for k in best.tolist()]
    letters = np.concatenate([[0], np.cumsum((buf >= 0x41) & (buf < 0x80) & LETTERS[buf])])
    _, offs = wb.raw(column)
    for i in np.flatnonzero(letters[offs[1:]] == letters[offs[:-1]]).tolist():  # no ASCII letter
        text = column[i].as_py()
        if not text or not any(c.isalpha() for c in text):
            lang[i], score[i] = "und", 0.0
    return lang, score


def language_spans(model: dict[str, object], text: str) -> list[tuple[int, int, str]]:
    """Runs of one language: start and end character, language."""
    starts, ends, _, label, buf = labelled(model, pa.array([text]))
    out: list[list] = []
    char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    for s, e, k in zip(starts.tolist(), ends.tolist(), label.tolist(), strict=True):
        if out and out[-1][2] == k:
            out[-1][1] = int(char[e])
        else:
            out.append([int(char[s]), int(char[e]), k])
    return [(a, b, model["names"][k]) for a, b, k in out]


def held_out(of: int = 3, which: int = 1) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == which, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> dict[str, object] | None:
    """The model of rows with a language that aren't held out, of at most ``sample`` rows of up to ``chars`` characters."""
    rows = docs.where("lang is not null").where(~held_out()).where(F.length("text").between(1, chars))
    keyed = rows.select("doc_id", "lang", F.xxhash64(F.lit(7), "doc_id").alias("key"))
    langs = keyed.groupBy("lang").count().count()
    each = max(LEAST, sample // max(1, langs))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))  # cut to `each` before the shuffle
    picked = keyed.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "key").distinct()
    got = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "lang", "text").collect()  # at most each * langs ids
    got = sorted({(r[0], r[1], r[2]) for r in got})
    model = learn([r[2] for r in got], [r[1] for r in got])
    del got
    wb.trimmed()
    return model


def identified(docs: DataFrame, model: dict[str, object] | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    wb.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size per language
    wide = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    limit = (1 << 20) * 16 // max(16, len(model["names"]) if model else 0)  # what a block takes grows with the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, limit=limit):
            lang, score = predict(shared.value, block.column(1))
            yield pa.record_batch([block.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return wide.mapInArrow(run, f"doc_id {wide.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op10_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(path_of(sf_dir, "documents"))
    model = train(docs.select("doc_id", "text", "lang"))
    return identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

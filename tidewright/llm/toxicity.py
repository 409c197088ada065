"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word embedding beside embeddings of its first 4 and 5 bytes and the mean over all its
4- and 5-grams of bytes. Words end at non-ASCII punctuation too; a run of over ``PIECE`` bytes, as of unspaced scripts, is read as
overlapping pieces that hold each of its 4- and 5-grams, and counts as so many words. Overlapping
windows of ``WINDOW`` words, ``STRIDE`` apart, cover every text whole; each window is read in both directions,
pooled by attention and scored; a document's score is the calibrated score of its highest window.

The network is fitted on the driver on at most ``sample`` labelled documents per class with texts of up to
``chars`` characters, parameters of :func:`train` (chosen by a hash of the id, so reruns agree); scoring covers all rows.

Defined results: a null or empty text is one window without words; a null label is no label; with no
labels, or of one class only, every score is the smoothed share of toxic labels; repeated rows get equal scores;
an empty table gives no rows. Only the id and the text are read; :func:`not_toxic` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordblocks as wb
from .scratch import dropped, path_of, released, written

WINDOW = 32
STRIDE = 16
HIDDEN = 8
SAMPLE = 1200
SAMPLE_CHARS = 20_000
SPARE = 3
THRESHOLD = 0.3
WORD_BITS, GRAM_BITS = 18, 16
WIDTHS = {"word": 4, "four": 2, "five": 2, "gram": 2}
INPUT = sum(WIDTHS.values())
GATES = 3 * HIDDEN
#: bytes of a piece, and between the starts of pieces: every 5-gram lies in one
PIECE, PIECE_STEP = 12, 8
PRIOR = 32.0
STEP_ROWS = 8192
BATCH = 128
#: from so many labelled documents on, a quarter of them is set aside for the calibration
ASIDE = 800
f4 = np.float32


def _punctuation(buf: np.ndarray) -> np.ndarray:
    """The bytes with spaces for punctuation and white space of Latin-1, General Punctuation, CJK, half- and full-width forms."""
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE2) | (buf == 0xE3) | (buf == 0xEF))
    if not len(lead):
        return buf
    pad = np.concatenate([buf, np.zeros(2, np.uint8)])
    first, second, third = buf[lead], pad[lead + 1], pad[lead + 2]
    two = (first == 0xC2) & np.isin(second, (0xA0, 0xA1, 0xA7, 0xAB, 0xB6, 0xB7, 0xBB, 0xBF))
    joiner = (second == 0x80) & (third >= 0x8B) & (third <= 0x8F) | (second == 0x81) & (third >= 0xA0)  # no break
    three = (first == 0xE2) & ((second == 0x80) | (second == 0x81)) & ~joiner
    three |= (first == 0xE3) & (second == 0x80) & ((third <= 0x84) | (third >= 0x88) & (third <= 0x9F) | (third == 0xB0))
    three |= (first == 0xE3) & (second == 0x83) & (third == 0xBB)
    three |= (first == 0xEF) & (second == 0xBC) & ((third >= 0x81) & (third <= 0x8F) | (third >= 0x9A) & (third <= 0xA0) | (third >= 0xBB) & (third <= 0xBF))
    three |= (first == 0xEF) & (second == 0xBD) & ((third == 0x80) | (third >= 0x9B) & (third <= 0xA5))
    out = buf.copy()
    for k, which in ((0, two | three), (1, two | three), (2, three)):
        out[lead[which] + k] = 0x20
    return out


def read_words(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features of all words and pieces, and per row the first (one more at the end)."""
    buf = _punctuation(buf)
    starts, ends, ptr = wb.spans(buf, offs, wb.ALNUM)
    hashed = wb.hashes(buf, starts, ends)
    count = 1 + np.maximum(0, -(-(ends - starts - PIECE) // PIECE_STEP))
    first = np.concatenate([[0], np.cumsum(count)])
    if first[-1] > len(starts):
        word = np.repeat(np.arange(len(starts)), count)
        begin = starts[word] + PIECE_STEP * (np.arange(first[-1]) - first[word])
        starts, ends, hashed = begin, np.minimum(begin + PIECE, ends[word]), hashed[word]
    return features(buf, starts, ends, hashed), first[ptr]


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> dict[str, np.ndarray]:
    """Bucket numbers per word or piece: of the word, the first 4 and 5 bytes, and all 4- and 5-grams and the last 4 bytes (-1: none)."""
    low = np.concatenate([wb.LOWER[buf], np.zeros(PIECE, np.uint8)]).astype(np.uint64)
    n = ends - starts
    bucket = lambda v: (wb.mix(v) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
    byte = [np.where(n > k, low[starts + k], np.uint64(0)) for k in range(5)]
    four = byte[0] | byte[1] << np.uint64(8) | byte[2] << np.uint64(16) | byte[3] << np.uint64(24)
    grams = np.full((2 * PIECE - 6, len(starts)), -1, np.int32)
    with np.errstate(over="ignore"):
        word = (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        tail = np.maximum(ends - 4, starts)
        last = sum(np.where(n > k, low[tail + k], np.uint64(0)) << np.uint64(8 * k) for k in range(4))
        grams[0] = bucket(last + np.uint64(1 << 41))
        run = low[:-4] | low[1:-3] << np.uint64(8) | low[2:-2] << np.uint64(16) | low[3:-1] << np.uint64(24)
        fours = bucket(run + np.uint64(1 << 40))
        fives = bucket((run | low[4:] << np.uint64(32)) + np.uint64(1 << 42))
        for row, size, table in ((1, 4, fours), (PIECE - 2, 5, fives)):
            for k in range(PIECE - size + 1):
                some = np.flatnonzero(n >= k + size)
                grams[row + k, some] = table[starts[some] + k]
        return {"word": word, "four": bucket(four), "five": bucket(four | byte[4] << np.uint64(32)), "gram": grams.T}


def windows(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window its first word and its end word; per row its first window. Rows without words have one."""
    n = np.diff(ptr)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(first[-1]) - first[row]
    start = ptr[row] + np.minimum(k * STRIDE, np.maximum(0, n[row] - WINDOW))
    return start, np.minimum(start + WINDOW, ptr[row + 1]), first


def places(start: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], at, pad)


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    small = lambda *s: rng.normal(0, 0.1, s).astype(f4)
    p = {f"e_{k}": small(1 << (WORD_BITS if k == "word" else GRAM_BITS), w) for k, w in WIDTHS.items()}
    for d in "fb":
        p |= {f"w_{d}": (rng.normal(0, 1, (INPUT, GATES)) / np.sqrt(INPUT)).astype(f4), f"u_{d}": (rng.normal(0, 0.5, (HIDDEN, GATES)) / np.sqrt(HIDDEN)).astype(f4), f"c_{d}": np.zeros(GATES, f4), f"att_{d}": small(HIDDEN), f"out_{d}": rng.normal(0, 0.5, HIDDEN).astype(f4)}
    return p | {"bias": np.zeros(1, f4)}


def embed(p: dict[str, np.ndarray], feats: dict[str, np.ndarray]) -> np.ndarray:
    g = feats["gram"]
    grams, count = np.zeros((len(g), WIDTHS["gram"]), p["e_gram"].dtype), np.zeros(len(g), f4)
    for k in range(g.shape[1]):
        some = np.flatnonzero(g[:, k] >= 0)
        grams[some] += p["e_gram"][g[some, k]]
        count[some] += 1
    grams /= np.maximum(1, count)[:, None]
    return np.concatenate([p["e_word"][feats["word"]], p["e_four"][feats["four"]], p["e_five"][feats["five"]], grams], 1).astype(f4)


def _projected(p: dict[str, np.ndarray], x: np.ndarray, d: str) -> np.ndarray:
    """Gate inputs per word, and a last row for padding that leaves the state as it is."""
    g = np.empty((len(x) + 1, GATES), f4)
    np.dot(x, p[f"w_{d}"], out=g[:-1])
    g[:-1] += p[f"c_{d}"]
    g[-1] = 0
    g[-1, :HIDDEN] = 30
    return g


def logits(p: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Window scores, in runs of windows that stay in cache."""
    gates = {d: _projected(p, x, d) for d in "fb"}
    out = np.empty(len(start), f4)
    for a in range(0, len(start), STEP_ROWS):
        at = places(start[a : a + STEP_ROWS], end[a : a + STEP_ROWS], len(x))
        att = np.where(at == len(x), f4(-1e9), f4(0))
        val = np.zeros(at.shape, f4)
        for d in "fb":
            u, g = p[f"u_{d}"], gates[d]
            heads = np.stack([p[f"att_{d}"], p[f"out_{d}"]], 1)
            h = np.zeros((len(at), HIDDEN), f4)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                now, hu = g[at[:, t]], h @ u
                zr = now[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
                zr *= f4(0.5)
                np.tanh(zr, out=zr)
                zr *= f4(0.5)
                zr += f4(0.5)
                n = hu[:, 2 * HIDDEN :]
                n *= zr[:, HIDDEN:]
                n += now[:, 2 * HIDDEN :]
                np.tanh(n, out=n)
                h -= n
                h *= zr[:, :HIDDEN]
                h += n
                both = h @ heads
                att[:, t] += both[:, 0]
                val[:, t] += both[:, 1]
        att -= att.max(1, keepdims=True)
        np.exp(att, out=att)
        att *= at != len(x)
        out[a : a + STEP_ROWS] = (att * val).sum(1) / np.maximum(att.sum(1), f4(1e-9)) + p["bias"][0]
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean cross-entropy over windows, its gradients, and those of the word inputs ``x``."""
    at, pad, m = places(start, end, len(x)), len(x), len(start)
    live = at != pad
    kept: dict[str, list] = {}
    states = {}
    for d in "fb":
        g, u = _projected(p, x, d), p[f"u_{d}"]
        h = np.zeros((m, HIDDEN), f4)
        kept[d], states[d] = [], np.zeros((m, WINDOW, HIDDEN), f4)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            now, hu = g[at[:, t]], h @ u
            zr = 1 / (1 + np.exp(-(now[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
            z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            n = np.tanh(now[:, 2 * HIDDEN :] + r * q)
            kept[d].append((t, h, z, r, q, n))
            h = (1 - z) * n + z * h
            states[d][:, t] = h
    att = sum(states[d] @ p[f"att_{d}"] for d in "fb") + np.where(live, f4(0), f4(-1e9))
    val = sum(states[d] @ p[f"out_{d}"] for d in "fb")
    alpha = np.exp(att - att.max(1, keepdims=True)) * live
    alpha /= np.maximum(alpha.sum(1, keepdims=True), 1e-9)
    pooled = (alpha * val).sum(1)
    prob = 1 / (1 + np.exp(-(pooled + p["bias"][0])))
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    dl = ((prob - y) / m).astype(f4)
    dval = dl[:, None] * alpha
    datt = dval * (val - pooled[:, None])
    grads = {"bias": np.array([dl.sum()], f4)}
    dx = np.zeros((len(x) + 1, INPUT), f4)
    for d in "fb":
        u, dh = p[f"u_{d}"], np.zeros((m, HIDDEN), f4)
        grads[f"att_{d}"] = np.einsum("mt,mth->h", datt, states[d])
        grads[f"out_{d}"] = np.einsum("mt,mth->h", dval, states[d])
        du, dg = np.zeros_like(u), np.zeros((len(x) + 1, GATES), f4)
        for t, h, z, r, q, n in reversed(kept[d]):
            dh = dh + datt[:, t, None] * p[f"att_{d}"] + dval[:, t, None] * p[f"out_{d}"]
            dan = dh * (1 - z) * (1 - n * n)
            gate = np.concatenate([dh * (h - n) * z * (1 - z), dan * q * r * (1 - r), dan * r], 1)
            du += h.T @ gate
            np.add.at(dg, at[:, t], np.concatenate([gate[:, : 2 * HIDDEN], dan], 1))
            dh = dh * z + gate @ u.T
        dg[-1] = 0
        grads[f"u_{d}"], grads[f"w_{d}"], grads[f"c_{d}"] = du, x.T @ dg[:-1], dg[:-1].sum(0)
        dx[:-1] += dg[:-1] @ p[f"w_{d}"].T
    return loss, grads, dx[:-1]


def _read(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features of all words, in 32 bits, and the texts' first words; read in blocks of bounded memory."""
    parts, sizes = [], []
    for block in wb.blocks([pa.record_batch([pa.array(texts, pa.string())], names=["text"])], limit=1 << 20):
        buf, offs = wb.raw(block.column(0))
        feats, ptr = read_words(buf, offs)
        parts.append({k: v.astype(np.int32) for k, v in feats.items()})
        sizes.append(np.diff(ptr))
    return {k: np.concatenate([p[k] for p in parts]) for k in WIDTHS}, np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _groups(ptr: np.ndarray, words: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many words, or one row."""
    at = 0
    while at < len(ptr) - 1:
        to = max(at + 1, int(np.searchsorted(ptr, ptr[at] + words, "right")) - 1)
        yield at, to
        at = to


def _all_logits(p: dict[str, np.ndarray], feats: dict[str, np.ndarray], ptr: np.ndarray) -> np.ndarray:
    out = []
    for a, b in _groups(ptr):
        own = {k: v[ptr[a] : ptr[b]] for k, v in feats.items()}
        start, end, _ = windows(ptr[a : b + 1] - ptr[a])
        out.append(logits(p, embed(p, own), start, end))
    return np.concatenate(out)


def fit(texts: list[str], toxic: list[int], steps: int = 120, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters learned from labelled texts.

    Embeddings start at the shrunken log odds of their bucket; documents lend their label to their
    strongest windows, first by those odds and then by the network itself.
    """
    y = np.array(toxic, f4)
    share = float((y.sum() + 1) / (len(y) + 2))
    if not 0 < y.sum() < len(y):
        return {"share": np.array([share if len(y) else 0.0])}
    rng = np.random.default_rng(seed)
    p = initial(rng)
    feats, ptr = _read(texts)
    wb.trimmed()
    aside = (np.arange(len(y)) % 4 == 3) & (len(y) >= ASIDE)  # for the calibration
    rate = y.mean()
    for k in WIDTHS:
        size = len(p[f"e_{k}"])
        seen, bad = np.zeros(size), np.zeros(size)
        for d0, d1 in _groups(ptr):
            v = feats[k][ptr[d0] : ptr[d1]].reshape(ptr[d1] - ptr[d0], -1).astype(np.int64)
            doc = np.repeat(np.arange(d0, d1), np.diff(ptr[d0 : d1 + 1]))[:, None]
            pair = np.unique((doc * (1 << 20) + v)[(v >= 0) & ~aside[doc]])
            seen += np.bincount(pair & ((1 << 20) - 1), minlength=size)
            bad += np.bincount(pair & ((1 << 20) - 1), weights=y[pair >> 20], minlength=size)
        p[f"e_{k}"][:, 0] = np.log((bad + PRIOR * rate) / (seen + PRIOR) / rate)
    start, end, first = windows(ptr)
    row = np.repeat(np.arange(len(y)), np.diff(first))
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0
    for phase in range(2):
        if phase:
            power = _all_logits(p, feats, ptr)
        else:
            words = p["e_word"][feats["word"], 0] + p["e_four"][feats["four"], 0] + p["e_five"][feats["five"], 0]
            odds = np.concatenate([[0], np.cumsum(np.maximum(0, words - 1), dtype=float)])
            power = odds[end] - odds[start]
        order = np.lexsort((rng.random(len(row)), -power, row))
        rank = np.arange(len(row)) - first[row[order]]
        chosen = order[(rank < 2) & ~aside[row[order]]]
        chosen = np.concatenate([chosen, rng.permutation(np.flatnonzero((y[row] == 0) & ~aside[row]))[: len(chosen) // 2]])
        for _ in range(max(3, -(-steps * BATCH // len(chosen)))):
            rng.shuffle(chosen)
            for a in range(0, len(chosen), BATCH):
                w = chosen[a : a + BATCH]
                at = places(start[w], end[w], -1)
                used, inverse = np.unique(at[at >= 0], return_inverse=True)
                place = np.full(at.shape, -1)
                place[at >= 0] = inverse
                own = {k: v[used] for k, v in feats.items()}
                n = (at >= 0).sum(1)
                begin = np.where(n > 0, place[:, 0], 0)
                blank = np.zeros(1 + len(w) // 16, np.int64)  # windows without words aren't toxic
                begin, n, target = np.concatenate([begin, blank]), np.concatenate([n, blank]), np.concatenate([y[row[w]], blank.astype(f4)])
                _, grads, dx = gradients(p, embed(p, own), begin, begin + n, target)
                step += 1
                for k, g in grads.items():
                    m1, m2 = state.get(k, (np.zeros_like(g), np.zeros_like(g)))
                    m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
                    state[k] = (m1, m2)
                    p[k] = (p[k] - 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(f4)
                c = 0
                for k, width in WIDTHS.items():
                    part = (-0.5 * dx[:, c : c + width]).astype(f4)
                    if k == "gram":
                        some = own[k] >= 0
                        np.add.at(p["e_gram"], own[k][some], np.repeat(part / np.maximum(1, some.sum(1))[:, None], some.sum(1), 0))
                    else:
                        np.add.at(p[f"e_{k}"], own[k], part)
                    c += width
    best = np.maximum.reduceat(_all_logits(p, feats, ptr), first[:-1])
    if 0 < y[aside].sum() < aside.sum():
        best, y = best[aside], y[aside]
    a, b = 1.0, 0.0
    for _ in range(100):  # damped Newton steps of a regularised logistic fit
        q = 1 / (1 + np.exp(-np.clip(a * best + b, -30, 30)))
        wt = q * (1 - q) + 1e-4
        g0, g1 = ((q - y) * best).sum() + 4 * (a - 0.7), (q - y).sum() + 0.01 * b
        h00, h01, h11 = (wt * best * best).sum() + 4, (wt * best).sum(), wt.sum() + 0.01
        det = h00 * h11 - h01 * h01
        a, b = a - 0.5 * (h11 * g0 - h01 * g1) / det, b - 0.5 * (h00 * g1 - h01 * g0) / det
    return p | {"calibration": np.array([max(a, 1e-3), b])}


def score_column(p: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    buf, offs = wb.raw(column)
    if "share" in p:
        return np.full(len(offs) - 1, p["share"][0])
    feats, ptr = read_words(buf, offs)
    start, end, first = windows(ptr)
    w = logits(p, embed(p, feats), start, end)
    a, b = p["calibration"]
    return 1 / (1 + np.exp(-np.clip(a * np.maximum.reduceat(w, first[:-1]).astype(float) + b, -30, 30)))


def held_out(of: int = 4, which: int = 2) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == which, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray]:
    """The network of labelled rows that aren't held out: at most ``sample`` of each class, with texts of up to ``chars`` characters.

    They are the first by a hash of the id; ``SPARE`` times as many are looked at, so that long texts leave the sample full.
    """
    rows = labels.where("toxic is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    of = lambda df, toxic, n: df.where(F.col("toxic") == toxic).orderBy(*order).limit(n)
    picked = of(rows, 1, SPARE * sample).unionByName(of(rows, 0, SPARE * sample))
    near = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.length("text") <= chars).select("doc_id", "toxic", "text")  # at most 2 * SPARE * sample ids
    near = written(near)
    found = of(near, 1, sample).unionByName(of(near, 0, sample))
    got = sorted({(r[0], r[1], r[2]) for r in found.select("doc_id", "toxic", "text").collect()})
    share = rows.agg(F.avg("toxic")).first()[0]
    released(docs.sparkSession)  # the driver's JVM gives memory back before the network takes it
    wb.trimmed()
    p = fit([r[2] for r in got], [r[1] for r in got])
    if "calibration" in p and share and 0 < share < 1:  # the sample's classes are balanced otherwise than the labels'
        own = sum(r[1] for r in got) / len(got)
        p["calibration"][1] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    del got
    dropped(near)
    wb.trimmed()
    return p


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row."""
    wb.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # of fixed size
    wide = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, limit=1 << 19):
            yield pa.record_batch([block.column(0), pa.array(score_column(shared.value, block.column(1)), pa.float64())], names=["doc_id", "score"])

    out = wide.mapInArrow(run, f"doc_id {wide.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic, in one pass over them."""
    wb.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    where = docs.columns.index("text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, limit=1 << 19):
            keep = score_column(shared.value, block.column(where)) < THRESHOLD
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in block.columns], names=names)

    return docs.mapInArrow(run, docs.schema)


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(path_of(sf_dir, "documents")).select("doc_id", "text")
    found = scored(docs, spark.read.parquet(path_of(sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")

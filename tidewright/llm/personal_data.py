"""Personal data in whole texts, disguised or not, with offsets into the source.

Plain identifiers (emails, IP addresses, card and phone numbers) are found as they stand. A
transducer then normalises look-alike characters, keeping for each character it writes the source
character it came from; over its output, grammars accept spelled digits and worded or bracketed ``at`` and
``dot``; what they detect is mapped back to source characters and added where the source itself isn't already
plain. Only texts whose bytes allow a disguise (:func:`traces` admits all that the grammars accept) go through the
transducer.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; spans of different kinds may
overlap, and of added ones of a kind the earliest, then longest, covers those within it; texts of any length are searched whole, in time in proportion;
equal rows get equal results; an empty table gives no rows; only the id and the text are read, and :func:`redacted` carries all
columns.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordblocks as wb
from .scratch import path_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind number, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": _CARD,
    "phone": _PHONE,
}

_DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_AT_WORDS = ("at", "arroba", "chez", "ät")
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_WORD = "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True))
_D = rf"(?:[0-9]|(?<![^\W\d_])(?:{_WORD})(?![^\W\d_]))"
_SEP = r"[\s.,()/-]{0,3}"
_ATW, _DOTW = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
_DOTSEP = rf"(?:\s?[(\[{{<]\s?(?:{_DOTW}|\.)\s?[)\]}}>]\s?|\s?[_*-]+(?:{_DOTW})[_*-]+\s?|\s+(?:{_DOTW})\s+|\s?\.(?=\S)|\s\.\s)"
_ATSEP = re.compile(rf"\s?[(\[{{<]\s?(?:{_ATW}|@|a)\s?[)\]}}>]\s?|\s?[_*-]+(?:{_ATW})[_*-]+\s?|(?P<bare>\s+(?:{_ATW})\s+)|\s?@\s?", re.I)
_ATOM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_WTOD = "|".join(w[::-1] for w in _DOT_WORDS)
#: the same read from right to left, up to the word before
_DOT_BACK = re.compile(rf"(?:\s?[)\]}}>]\s?(?:{_WTOD}|\.)\s?[(\[{{<]\s?|\s?[_*-]+(?:{_WTOD})[_*-]+\s?|\s+(?:{_WTOD})\s+|\.\s?|\s\.\s)(?=[A-Za-z0-9_%+-])", re.I)
_DOT_WITHIN = re.compile(rf"[_-]*(?:{_DOTW})[_-]+", re.I)
_RIGHT = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_DOTSEP})[A-Za-z0-9-]+)+", re.I)
_WORDED = re.compile(rf"(?<![A-Za-z])(?:{_DOTW})(?![A-Za-z])|[(\[{{<]\s?\.\s?[)\]}}>]", re.I)
#: after "name at host.tld" without other disguise: endings that make it an address, and words before that don't
_HOSTS = frozenset(("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "uk", "de", "fr", "es", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "mx", "ar", "br", "pl", "se", "ru", "jp", "cn", "in", "au"))
_BEFORE_HOSTS = frozenset(
    ("available", "found", "look", "looking", "us", "me", "him", "her", "them", "it", "is", "are", "was", "page", "site", "website", "online", "here", "more", "read", "see", "visit", "hosted", "published", "info")
    + ("information", "details", "article", "post", "blog", "work", "works", "working", "store", "shop", "home", "everyone", "team", "folks", "people", "located", "live", "up", "out", "and", "or", "that", "this", "the")
)
_PART = rf"{_D}(?:[\s-]?{_D}){{0,2}}"
_IP_SAID = re.compile(rf"(?<![A-Za-z0-9.])({_PART}){_DOTSEP}({_PART}){_DOTSEP}({_PART}){_DOTSEP}({_PART})(?![A-Za-z0-9])", re.I)
_CARD_SAID = re.compile(rf"(?<![A-Za-z0-9+]){_D}(?:{_SEP}{_D}){{13,18}}(?![A-Za-z0-9])", re.I)
_PHONE_SAID = re.compile(rf"(?:\+|(?<![A-Za-z])plus\s)\s?{_D}(?:{_SEP}{_D}){{9,14}}(?![A-Za-z0-9])", re.I)
_ONE = re.compile(_D, re.I)


def _lookalikes() -> dict[str, str]:
    table = {}
    for a, b in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2474), (0x24B6, 0x24EB), (0x2070, 0x209D), (0x2100, 0x2140), (0xA0, 0x100), (0x2000, 0x2070), (0xFE50, 0xFE70), (0x1F130, 0x1F14A)):
        for c in map(chr, range(a, b)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c and plain.isascii():
                table[c] = plain
    for code in range(0x660, 0x1FBFA):
        if code < 0x3000 or 0xA000 < code < 0xAC00 or 0x10000 < code < 0x12000 or code > 0x1FBEF:
            c = chr(code)
            if unicodedata.category(c) == "Nd":
                table[c] = str(unicodedata.digit(c))
    pairs = (
        "аaеeоoрpсcуyхxіiјjѕsԁdһhӏlԛqԝwкkмmтtвbнhпnгrиuүyАAВBЕEКKМMНHОOРPСCТTХXУYІIЈJЅSЗ3Ӏl"
        "αaοoνvρpιiκkτtυuχxεeηnγyωwΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϲcϳj"
        "ɑaɡgıiℓlƅbոnսuօoոnհhցg﹒.。.．.․.·.‐-‑-‒-–-—-−-﹣-⁃-﹢+﹫@٠0۰0"
    )
    for k in range(0, len(pairs), 2):
        table.setdefault(pairs[k], pairs[k + 1])
    for c in "­​‌‍⁠﻿᠎‎‏":
        table[c] = ""
    for c in "               　":
        table[c] = " "
    return table


_ALIKE = _lookalikes()
_ALIKE_RUN = re.compile("[" + "".join(map(re.escape, sorted(_ALIKE))) + "]")


def transduced(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes replaced, and per character its place in the source (None: the same)."""
    out, place, at = [], [], 0
    for m in _ALIKE_RUN.finditer(text):
        k = m.start()
        out.append(text[at:k])
        place.extend(range(at, k))
        if plain := _ALIKE[m[0]]:
            out.append(plain)
            place.append(k)
        at = k + 1
    if not at:
        return text, None
    out.append(text[at:])
    place.extend(range(at, len(text)))
    return "".join(out), place


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _ok(kind: str, plain: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in plain.split("."))
    digits = "".join(c for c in plain if "0" <= c <= "9")
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the plain pattern, each ``@`` looked at once."""
    done, k = 0, text.find("@")
    while k >= 0:
        s = k
        while s > done and _LOCAL.match(text, s - 1):
            s -= 1
        if s < k and (m := _DOMAIN.match(text, k + 1)):
            yield s, m.end()
            done = m.end()
        k = text.find("@", max(k + 1, done))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(s, 0, e) for s, e in emails(text)]
    for n, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out.extend((m.start(), n, m.end()) for m in pattern.finditer(text) if _ok(KINDS[n], m[0]))
    return sorted(out)


def _said(text: str) -> str:
    """Digits of a run of digits and digit words."""
    return "".join(m[0] if m[0].isdigit() else str(_DIGITS[m[0].lower()]) for m in _ONE.finditer(text))


def _local_part(plain: str, back: str, least: int, end: int) -> int:
    """Where the local part that ends at ``end`` begins, from ``least`` on: words joined by dots, disguised or not. ``back``: the text reversed."""
    n, found, s = len(plain), end, end
    while True:
        a = s
        while a > least and plain[a - 1] in _ATOM:
            a -= 1
        if a == s:
            break
        found = a
        m = _DOT_BACK.match(back, n - a, n - least)
        if m is None and (within := _DOT_WITHIN.match(plain, a, s)) and within.end() < s:
            m = _DOT_BACK.match(back, n - within.end(), n - least)
        if m is None:
            break
        s = n - m.end()
    if found == end:
        while found > least and (plain[found - 1] in _ATOM or plain[found - 1] == "."):
            found -= 1
    return found


def added_spans(text: str, known: list[Span]) -> list[Span]:
    """Disguised identifiers: spans whose source isn't a plain identifier of that kind already."""
    plain, place = transduced(text)
    found: list[tuple[int, int, int]] = []
    done, back = 0, ""
    for m in _ATSEP.finditer(plain):
        if m.start() < done:
            continue
        right = _RIGHT.match(plain, m.end())
        if not right or not re.search(r"[A-Za-z]", right[0]):
            continue
        back = back or plain[::-1]
        left = _local_part(plain, back, done, m.start())
        if left == m.start():
            continue
        local = plain[left : m.start()]
        if m["bare"]:
            last = re.split(r"[^A-Za-z0-9-]", right[0])[-1].lower()
            if not _WORDED.search(right[0]) and not re.search(r"[0-9._]", local) and (last not in _HOSTS or local.lower() in _BEFORE_HOSTS):
                continue
            if plain[right.end() : right.end() + 1] == "@" or not re.fullmatch(r"[A-Za-z]{2,}", re.split(r"[^A-Za-z0-9-]", right[0])[-1]):
                continue
        elif m[0].strip() == "@" and m[0] != "@" and not re.fullmatch(r"[A-Za-z]{2,}", re.split(r"[^A-Za-z0-9-]", right[0])[-1]):
            continue
        found.append((left, 0, right.end()))
        done = right.end()
    for m in _IP_SAID.finditer(plain):
        if all(int(_said(m[k])) <= 255 for k in range(1, 5)):
            found.append((m.start(), 1, m.end()))
    for n, pattern in ((2, _CARD_SAID), (3, _PHONE_SAID)):
        for m in pattern.finditer(plain):
            if _ok(KINDS[n], _said(m[0])):
                found.append((m.start(), n, m.end()))
    if place is not None:
        found += [(s, k, e) for s, k, e in base_spans(plain)]
        found = [(place[s], k, place[e - 1] + 1) for s, k, e in found]
    have = set(known)
    out = []
    for s, k, e in sorted(set(found), key=lambda x: (x[1], x[0], -x[2])):
        if (s, k, e) in have or _PLAIN[KINDS[k]].fullmatch(text, s, e) or any(o[1] == k and o[0] <= s and e <= o[2] for o in out[-1:]):
            continue
        if any(o[1] == k and (o[0] <= s and e <= o[2] or o[0] == s) for o in known):  # a plain one isn't lengthened by a word for a digit after it
            continue
        out.append((s, k, e))
    return out


def _hashed(words: Iterable[str]) -> np.ndarray:
    coded = [w.encode() for w in words]
    return np.unique(np.concatenate([wb.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in coded]))


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_HINTS, _DOT_HINTS, _AT_HINTS = _hashed(_DIGITS), _hashed(_DOT_WORDS), _hashed((*_AT_WORDS, "a"))
_A_HINT = _hashed(("a",))
#: first bytes of what isn't ASCII or U+00C0 to U+00FF: look-alikes, white space, folded letters
_STRANGE = np.zeros(256, bool)
_STRANGE[[0xC2, *range(0xC4, 0xF8)]] = True
_SPACE = _bytes(bytes((*range(0x09, 0x0E), *range(0x1C, 0x21))))
_OPEN = _bytes(b"([{<")
_JOINT = _SPACE | _OPEN | _bytes(b")]}>_*-")
_DIGIT = _bytes(b"0123456789")
_BETWEEN = _SPACE | _bytes(b".,()/-")
_LETTER = wb.ALNUM & ~_DIGIT
_HOST = (wb.ALNUM & (np.arange(256) < 0x80)) | _bytes(b"-")


def _in(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


def traces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: may it hold plain identifiers; may it hold disguised ones, that is, all that the grammars accept.

    Rows of ASCII and U+00C0 to U+00FF are judged by what each grammar needs: an email any ``@``, or an at-word
    followed by host characters up to a dot or dot-word; an IP address three dots or dot-words with nothing but
    digits, spelled or not, around and between them; cards and phones a run of digits with only separators
    between. All other rows, and those with the two signs among these letters, may hold any.
    """
    def rows(at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(offs, at, "right") - 1, minlength=len(offs) - 1)

    n = len(buf)
    if not n:
        return np.zeros(len(offs) - 1, bool), np.zeros(len(offs) - 1, bool)
    pad = np.concatenate([buf, np.full(3, 0x20, np.uint8)])  # also what pad[-1] finds
    digit = _DIGIT[buf]
    ats = rows(np.flatnonzero(buf == 0x40)) > 0
    plain = (rows(np.flatnonzero(digit)) >= 4) | ats
    latin = np.flatnonzero(buf == 0xC3)
    signs = latin[(pad[latin + 1] == 0x97) | (pad[latin + 1] == 0xB7)]
    hidden = ats | (rows(np.flatnonzero(_STRANGE[buf])) > 0) | (rows(signs) > 0)
    capital = latin[(pad[latin + 1] >= 0x80) & (pad[latin + 1] < 0x9F)] + 1
    if len(capital):
        buf = buf.copy()
        buf[capital] += 0x20
    starts, ends, _ = wb.spans(buf, offs, _LETTER)
    short = np.flatnonzero(ends - starts <= 7)
    starts, ends = starts[short], ends[short]
    h = wb.hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)

    solid = np.flatnonzero(~_JOINT[buf])  # bytes that aren't joints; an index past the last is n
    def before(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(solid, at) - 1
        return np.where(k >= 0, solid[np.maximum(k, 0)], -1) if len(solid) else np.full(len(at), -1)

    def after(at: np.ndarray) -> np.ndarray:
        return np.append(solid, n)[np.searchsorted(solid, at)]

    dot = np.flatnonzero(buf == 0x2E)
    dot = dot[~_SPACE[pad[dot + 1]] | _SPACE[pad[dot - 1]] | _OPEN[pad[dot - 1]]]
    said = _in(_DOT_HINTS, h)
    dots, dots_end = np.concatenate([dot, starts[said]]), np.concatenate([dot + 1, ends[said]])
    order = np.argsort(dots)
    dots, dots_end = dots[order], dots_end[order]
    left, right = before(dots), after(dots_end)

    at = _in(_AT_HINTS, h)
    s, e, single = starts[at], ends[at], _in(_A_HINT, h[at])
    prior, next_ = pad[s - 1], pad[e]
    bracket = _OPEN[prior] | (_SPACE[prior] & _OPEN[pad[s - 2]])
    ok = _JOINT[next_] & np.where(single, bracket, _JOINT[prior])
    s, e = s[ok], e[ok]
    if len(s) and len(dots):
        alien = np.concatenate([[0], np.cumsum(~_HOST[buf], dtype=np.int32)])
        host = after(e)
        k = np.searchsorted(dots, host)
        there, k = k < len(dots), np.minimum(k, len(dots) - 1)
        near = (dots[k] == host) | ((left[k] >= host) & (alien[left[k] + 1] == alien[np.minimum(host, n)]))
        hidden |= rows(s[there & near]) > 0

    number = _in(_HINTS, h)
    edge = np.zeros(n + 1, np.int8)
    edge[starts[number]] += 1
    edge[ends[number]] -= 1
    marked = digit | (np.cumsum(edge[:-1], dtype=np.int8) > 0)
    if len(dots) > 2:
        flanked = (left >= 0) & (right < n) & marked[left] & marked[np.minimum(right, n - 1)]
        alien = np.concatenate([[0], np.cumsum(~(marked | _JOINT[buf]), dtype=np.int32)])
        part = flanked[:-1] & flanked[1:] & (left[1:] >= right[:-1]) & (alien[np.maximum(left[1:], 0) + 1] == alien[right[:-1]])
        hidden |= rows(dots[:-2][part[:-1] & part[1:]]) > 0

    units = np.sort(np.concatenate([np.flatnonzero(digit), starts[number]]))
    if len(units):
        breaks = np.flatnonzero(~(marked | _BETWEEN[buf]))
        run = np.searchsorted(breaks, units)
        size = np.bincount(run)[run]
        prior = buf[breaks[np.maximum(run - 1, 0)]] if len(breaks) else np.zeros(len(units), np.uint8)
        led = (run > 0) & ((prior == 0x2B) | (prior == 0x73) | (prior == 0x53))  # + or the end of "plus"
        hidden |= rows(units[(size >= 14) | (led & (size >= 10))]) > 0
    return plain, hidden


def find(column: pa.Array) -> Iterator[tuple[list[Span], list[Span]]]:
    """Per row its plain and its added spans."""
    plain, hidden = traces(*wb.raw(column))
    for k in range(len(column)):
        text = column[k].as_py() if plain[k] or hidden[k] else ""
        base = base_spans(text) if plain[k] else []
        yield base, added_spans(text, base) if hidden[k] else []


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def identifiers(docs: DataFrame) -> DataFrame:
    """Per document: counts per kind, ``base_sha256``, ``spans`` (all), ``n_added``, and ``n_total`` of all kinds."""
    wb.small_batches(docs.sparkSession)
    wide = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, limit=1 << 21):
            counts, digests, spans, added = [[] for _ in KINDS], [], [], []
            for base, more in find(block.column(1)):
                both = base + more
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in both))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
                added.append(len(more))
            yield pa.record_batch(
                [block.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    found = wide.mapInArrow(run, f"doc_id {wide.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return found.withColumn("n_total", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")))


def redacted_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earliest, then longest."""
    if not text:
        return text
    base, more = next(find(pa.array([text])))
    out, at = [], 0
    for s, k, e in sorted(base + more, key=lambda x: (x[0], -x[2], x[1])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind."""
    where, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[where] = pa.array([redacted_text(t) for t in b.column(where).to_pylist()], b.column(where).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op1_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(spark.read.parquet(path_of(sf_dir, "documents")))

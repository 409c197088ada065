"""Session pseudonyms: typed, numbered tokens for names, scrubbing them from text and putting them back.

The map of a session is a DataFrame ``(kind, real_key, real, token, kind_seq, global_seq)``; it holds real
names and is never written by this module. :func:`scrub` and :func:`hydrate` hold it on the driver and, as a
broadcast, in each Python worker.
"""

from __future__ import annotations

import functools
import heapq
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column, is_blank, trim_ws
from ..shared import numbered

KINDS = ("ACCOUNT", "PARTNER", "VENDOR")
#: shorter names are left in text
SHORTEST = 4


def identity_map(names: DataFrame, ordinal: str = "ordinal", kind: str = "kind", name: str = "name") -> DataFrame:
    """Number the distinct names of each kind in order of first appearance.

    Names compare without case and outer white space; the first spelling is kept. Only distinct names are
    numbered, all kinds in one global order that spreads over tasks, less the numbers of the kinds before. What is written on
    the way holds digests under a key of its own instead of names; equal ordinals go by those.
    """
    named = names.select(F.col(ordinal).alias("at"), F.upper(F.col(kind)).alias("kind"), trim_ws(name).alias("real")).where(~is_blank("real"))
    first = named.groupBy("kind", F.lower("real").alias("real_key")).agg(F.min_by("real", "at").alias("real"), F.min("at").alias("at"))
    first = first.withColumn("digest", F.sha2(F.concat(F.lit(secrets.token_hex(16)), "real_key"), 256))
    order = numbered(first.select("kind", "at", "digest"), [F.col("kind"), F.col("at"), F.col("digest")], "place")
    begins = order.groupBy(F.col("kind").alias("of")).agg(F.min("place").alias("begin"))
    placed = order.join(begins, F.col("kind").eqNullSafe(F.col("of"))).select(F.col("kind").alias("of"), F.col("digest").alias("own"), (F.col("place") - F.col("begin") + 1).cast("int").alias("kind_seq"))
    first = first.join(placed, (F.col("digest") == F.col("own")) & F.col("kind").eqNullSafe(F.col("of")))
    token = F.concat(F.col("kind"), F.lit("_"), F.printf(F.lit("%02d"), F.col("kind_seq")))
    kind_order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return first.withColumn("token", token).select("kind", "real_key", "real", "token", "kind_seq", F.col("at").alias("global_seq"), kind_order.alias("kind_order"))


def identity_count(identities: DataFrame) -> DataFrame:
    return identities.agg(F.count("*").alias("identities"))


def anonymize(rows: DataFrame, identities: DataFrame, kind: str, name: str, out: str) -> DataFrame:
    """Replace a column of names by tokens; blank names become empty."""
    own = identities.where(F.col("kind") == kind.upper()).select(F.col("real_key").alias("_key"), F.col("token").alias("_token"))
    keyed = rows.withColumn("_key", F.lower(trim_ws(name)))
    return keyed.join(own, "_key", "left").withColumn(out, F.when(is_blank(name), F.lit("")).otherwise(F.col("_token"))).drop("_key", "_token")


@functools.cache
def _folds() -> dict[int, str]:
    """What characters fold to that have a case: lower(upper(c)) as Java's patterns do, always one character."""
    one = lambda c, *ways: next((w for w in ways if len(w) == 1), c)
    upper = {c: one(chr(c), chr(c).upper(), chr(c).title()) for c in range(0x20000)}  # beyond, none has a case
    return {c: f for c, u in upper.items() if (f := "i" if u == "\u0130" else one(u, u.lower())) != chr(c)}


def folded(text: str) -> str:
    """A text without case, of the same length."""
    return text.lower() if text.isascii() else text.translate(_folds())


class Replacements:
    """Words replaced one after the other on the text so far, with the result of a loop over all of them.

    Only words that occur are visited: a text's words are looked up by first characters and length, and after each
    replacement those that may have come about around it. A word's rank is its place in ``pairs``.
    """

    def __init__(self, pairs: list[tuple[str, str]], fold: bool = False):
        self.pairs, self.fold = [p for p in pairs if p[0]], fold

    @functools.cached_property
    def index(self) -> tuple[dict[str, list[int]], dict[str, int], dict[int, int], int, int]:
        """Lengths of words by how they begin, each word's first rank, the next rank of an equal word, the length of beginnings, the longest word."""
        words = [folded(w) if self.fold else w for w, _ in self.pairs]
        begin = min(map(len, words), default=0)
        lengths: dict[str, set[int]] = {}
        first: dict[str, int] = {}
        again: dict[int, int] = {}
        for rank in range(len(words) - 1, -1, -1):
            w = words[rank]
            lengths.setdefault(w[:begin], set()).add(len(w))
            if w in first:
                again[rank] = first[w]
            first[w] = rank
        return {w: sorted(n) for w, n in lengths.items()}, first, again, begin, max(map(len, words), default=0)

    def _due(self, seen: str, start: int, end: int, last: int) -> Iterator[int]:
        """The next rank after ``last`` of each word within a part of the text."""
        lengths, first, again, begin, _ = self.index
        for at in range(start, end - begin + 1):
            for n in lengths.get(seen[at : at + begin], ()):
                if at + n > end:
                    break
                rank = first.get(seen[at : at + n])
                while rank is not None and rank <= last:
                    rank = again.get(rank)
                if rank is not None:
                    yield rank

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.pairs:
            return text
        around = self.index[-1] - 1
        seen = folded(text) if self.fold else text
        due = sorted(set(self._due(seen, 0, len(seen), -1)))
        last = -1
        while due:
            rank = heapq.heappop(due)
            if rank == last:
                continue
            last, (word, new) = rank, self.pairs[rank]
            rest = seen.split(folded(word) if self.fold else word)
            if len(rest) == 1:  # an earlier word took it
                continue
            if self.fold:
                kept, at = [], 0
                for part in rest:
                    kept.append(text[at : at + len(part)])
                    at += len(part) + len(word)
                text, seen = new.join(kept), folded(new).join(rest)
            else:
                text = seen = new.join(rest)
            at, parts = len(rest[0]), [(0, 0)]
            for part in rest[1:]:
                start, end = max(0, at - around), min(len(seen), at + len(new) + around)
                if start <= parts[-1][1]:
                    parts[-1] = parts[-1][0], end
                else:
                    parts.append((start, end))
                at += len(new) + len(part)
            for rank in {r for start, end in parts for r in self._due(seen, start, end, last)}:
                heapq.heappush(due, rank)
        return text


def _replaced(rows: DataFrame, text: str, pairs: list[tuple[str | None, str | None]], fold: bool = False) -> Column:
    if any(None in p for p in pairs):  # a name without a kind has no token; rather no text than one that shows it
        return F.lit(None).cast("string")
    shared = rows.sparkSession.sparkContext.broadcast(Replacements(pairs, fold))  # a session's map

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((shared.value(t.as_py()) for t in texts), pa.string())

    return F.arrow_udf(run, "string")(F.make_valid_utf8(as_column(text).cast("string")))


def _ordered(identities: DataFrame, *order: str) -> list[tuple[str | None, str | None]]:
    """Real names and tokens in an order of columns, nulls first."""
    got = identities.select("real", "token", F.struct(*order).alias("order")).collect()  # a session's map
    return [(r["real"], r["token"]) for r in sorted(got, key=lambda r: [(v is not None, v) for v in r["order"]])]


def scrub(rows: DataFrame, identities: DataFrame, text: str, out: str) -> DataFrame:
    """Names in ``text`` replaced by tokens, one name after the other on the text so far, without case and word boundaries."""
    names = _ordered(identities, "kind_order", "kind_seq", "real", "token")
    return rows.withColumn(out, _replaced(rows, text, [(real, token) for real, token in names if len(real) >= SHORTEST], fold=True))


def hydrate(rows: DataFrame, identities: DataFrame, text: str, out: str, longest_first: bool = False) -> DataFrame:
    """Tokens in ``text`` replaced by names in order of registration; a token that begins another one spoils it.

    ``longest_first`` avoids that by going from the longest token to the shortest.
    """
    names = _ordered(identities, "global_seq", "kind_order", "token", "real")
    if longest_first:
        names.sort(key=lambda n: -len(n[1] or ""))
    return rows.withColumn(out, _replaced(rows, text, [(token, real) for real, token in names]))

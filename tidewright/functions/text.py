"""Text expressions shared by the operators; all are built-in column expressions."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Trim all Unicode white space (``trim`` only takes spaces)."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def rtrim_ws(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), r"(?U)\s+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.length(trim_ws(c)) == 0, F.lit(True))


def norm_header(c: Column | str) -> Column:
    """Header names compare without white space and case."""
    return F.lower(F.regexp_replace(as_column(c), r"(?U)\s", ""))


def strip_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]", "")


def unfence(c: Column | str) -> Column:
    """Content of the first Markdown fence, else the trimmed text; blank text comes back as it is, null as empty."""
    raw = F.coalesce(as_column(c), F.lit(""))
    s = trim_ws(raw)
    opened = F.instr(s, FENCE)
    newline = F.call_function("locate", F.lit("\n"), s, F.greatest(opened, F.lit(1)))
    start = F.when(newline == 0, opened + 3).otherwise(newline + 1)
    close = F.call_function("locate", F.lit(FENCE), s, start)
    rest = F.call_function("substring", s, start)
    inner = F.when(close == 0, rest).otherwise(F.call_function("substring", s, start, close - start))
    return F.when(is_blank(raw), raw).when(opened == 0, s).otherwise(trim_ws(inner))


def url_escape(text: str) -> str:
    """Percent-encode a key for one path segment."""
    return quote(text, safe="")


def url_escaped(c: Column | str) -> Column:
    """The same of a column (``url_encode`` is for forms)."""
    out = F.url_encode(as_column(c))
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def cache_key(*parts: Column | str) -> Column:
    """A lookup key out of several columns, nulls as empty."""
    return F.concat_ws("\x1f", *[F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts])

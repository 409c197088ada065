"""Text and page data out of a document layout, as array expressions; masking goes through Arrow, once over each text.

A layout has ``pages`` (page_number, width, height, unit, words, lines), ``paragraphs`` (content,
bounding_regions) and ``tables`` (cells of row, col, content); see ``LAYOUT``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import as_column, is_blank, rtrim_ws

LAYOUT = (
    "struct<pages:array<struct<page_number:int,width:double,height:double,unit:string,words:array<struct<content:string,confidence:float,polygon:array<float>>>,"
    "lines:array<struct<content:string,polygon:array<float>>>>>,"
    "paragraphs:array<struct<content:string,bounding_regions:array<struct<page_number:int,polygon:array<float>>>>>,"
    "tables:array<struct<cells:array<struct<row:int,col:int,content:string>>>>>"
)
#: Unicode's white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: a word below it is unsure; compared as 32-bit floats
THRESHOLD = 0.50
UNSURE, SIGNATURE = "[?]", "[SIGNATURE/HANDWRITING]"


def _count(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def page_words(pages: Column, number: Column) -> Column:
    """Words of a page; of pages with one number the last counts, and null means no such page."""
    same = F.filter(pages, lambda p: p["page_number"] == number)
    return F.try_element_at(F.transform(same, lambda p: F.coalesce(p["words"], F.array().cast("array<struct<content:string,confidence:float,polygon:array<float>>>"))), F.lit(-1))


def _sizes(lists: pa.Array) -> list[int]:
    return pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()


def _unsure(words: pa.Array) -> Iterator[tuple[dict[str | None, list[int]], list[bool | None]]]:
    """Per list of words the places of each, without case, and which are unsure."""
    flat, at = words.flatten(), 0
    folded = [w if w is None else w.lower() for w in flat.field("content").to_pylist()]
    low = pa.compute.less(flat.field("confidence"), pa.scalar(THRESHOLD, pa.float32())).to_pylist()
    for n in _sizes(words):
        places: dict[str | None, list[int]] = {}
        for k in range(n):
            places.setdefault(folded[at + k], []).append(k)
        yield places, low[at : at + n]
        at += n


def _masked_text(texts: pa.Array, words: pa.Array) -> pa.Array:
    return pa.array([_marked(t, *w) for t, w in zip(texts.to_pylist(), _unsure(words), strict=True)], pa.string())


def _body_text(pages: pa.Array, paragraphs: pa.Array) -> pa.Array:
    page = pages.flatten()
    numbers, words, lines = page.field("page_number").to_pylist(), list(_unsure(page.field("words"))), page.field("lines")
    line, per_page = lines.flatten().field("content").to_pylist(), _sizes(lines)
    paragraph = paragraphs.flatten()
    said, regions = paragraph.field("content").to_pylist(), paragraph.field("bounding_regions")
    region, per_paragraph = regions.flatten().field("page_number").to_pylist(), _sizes(regions)
    shown = lambda t, found: "" if not t or not t.strip(WHITE) else (_marked(t, *found) or "")
    ended = lambda t, end: t + end if t.strip(WHITE) else ""
    out, p, x, q, r = [], 0, 0, 0, 0
    for n_pages, n_paragraphs in zip(_sizes(pages), _sizes(paragraphs), strict=True):
        known = dict(zip(numbers[p : p + n_pages], words[p : p + n_pages], strict=True))  # of pages with one number the last counts
        parts = []
        for k in range(q, q + n_paragraphs):
            number = region[r] if per_paragraph[k] else 0
            parts.append(ended(shown(said[k], known.get(number or 0, ({}, []))), "\n\n"))
            r += per_paragraph[k]
        for k in range(p, p + n_pages):
            if not n_paragraphs:
                parts += [ended(shown(t, known[numbers[k]]), "\n") for t in line[x : x + per_page[k]]] + ["\n"]
            x += per_page[k]
        p, q = p + n_pages, q + n_paragraphs
        out.append("".join(parts))
    return pa.array(out, pa.string())


def _marked(text: str | None, places: dict[str | None, list[int]], unsure: list[bool | None]) -> str | None:
    tokens = [t for t in (text or "").split(" ") if t]
    if not unsure or not tokens:
        return text
    at, marks, count = 0, [], 0
    for token in tokens:
        ahead = places.get(token.lower(), [])
        k = bisect.bisect_left(ahead, at)  # the place only moves forward
        if k < len(ahead):
            at = ahead[k] + 1
        if k < len(ahead) and unsure[at - 1]:
            count += 1
            if not marks or marks[-1] != UNSURE:
                marks.append(UNSURE)
        elif token != UNSURE or not marks or marks[-1] != UNSURE:
            marks.append(token)
    return SIGNATURE if count == len(tokens) else " ".join(marks)


def masked(text: Column | str, words: Column) -> Column:
    """Unsure words of a text replaced by a marker.

    The scan over the page's words only moves forward: a word found at i makes the next one look from i + 1,
    a word not found leaves the place. Markers in a row become one; a text of unsure words only is a signature.
    """
    return F.arrow_udf(_masked_text, "string")(as_column(text), words)


def table_markdown(cells: Column | str) -> Column:
    """A table's lines between markers; pipes in cells are escaped, missing cells are empty, of two in one place the first counts.

    A table without cells raises.
    """
    cells = as_column(cells)
    last = lambda f: F.array_max(F.transform(cells, lambda c: c[f]))
    content = lambda r, k: F.coalesce(F.replace(F.try_element_at(F.filter(cells, lambda c: (c["row"] == r) & (c["col"] == k)), F.lit(1))["content"], F.lit("|"), F.lit("\\|")), F.lit(""))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    columns = F.sequence(F.lit(0), last("col"))
    rows = F.transform(F.sequence(F.lit(0), last("row")), lambda r: line(F.transform(columns, lambda k: content(r, k))))
    rule = line(F.transform(columns, lambda _: F.lit("---")))
    lines = F.concat(F.array(F.lit("[TABLE]")), F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.lit("[/TABLE]")))
    return F.when(_count(cells) == 0, F.raise_error(F.lit("a table has no cells")).cast("string")).otherwise(F.array_join(lines, "\n"))


def structured_text(layout: Column | str) -> Column:
    """The document's text: its paragraphs, or without any the lines by page, then its tables."""
    d = as_column(layout)
    pages, paragraphs, tables = d["pages"], d["paragraphs"], d["tables"]

    body = F.arrow_udf(_body_text, "string")(pages, paragraphs)
    drawn = F.coalesce(F.array_join(F.transform(tables, lambda t: F.concat(F.lit("\n"), table_markdown(t["cells"]), F.lit("\n\n"))), ""), F.lit(""))
    return rtrim_ws(F.concat(body, drawn))


def page_data(layout: Column | str) -> Column:
    """Pages with words, lines and, per bounding region, paragraphs; regions of unknown pages are dropped."""
    d = as_column(layout)
    floats = lambda p: F.coalesce(p, F.array().cast("array<float>"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    regions = F.flatten(F.transform(d["paragraphs"], lambda p: F.transform(none(p["bounding_regions"], "array<struct<page_number:int,polygon:array<float>>>"), lambda r: F.struct(r["page_number"].alias("page_number"), p["content"].alias("content"), floats(r["polygon"]).alias("polygon")))))
    regions = none(regions, "array<struct<page_number:int,content:string,polygon:array<float>>>")
    numbers = F.transform(d["pages"], lambda p: p["page_number"])

    def page(p: Column, i: Column) -> Column:
        first = F.array_position(numbers, p["page_number"]) == i + 1
        own = F.filter(regions, lambda r: first & (r["page_number"] == p["page_number"]))
        return F.struct(
            p["page_number"].alias("page_number"), F.coalesce(p["width"], F.lit(0.0)).alias("width"), F.coalesce(p["height"], F.lit(0.0)).alias("height"), F.coalesce(p["unit"], F.lit("inch")).alias("unit"),
            F.transform(none(p["words"], "array<struct<content:string,confidence:float,polygon:array<float>>>"), lambda w: F.struct(w["content"].alias("content"), w["confidence"].cast("double").alias("confidence"), floats(w["polygon"]).alias("polygon"))).alias("words"),
            F.transform(none(p["lines"], "array<struct<content:string,polygon:array<float>>>"), lambda x: F.struct(x["content"].alias("content"), floats(x["polygon"]).alias("polygon"))).alias("lines"),
            F.transform(own, lambda r: F.struct(r["content"].alias("content"), r["polygon"].alias("polygon"))).alias("paragraphs"),
        )

    kind = "array<struct<page_number:int,width:double,height:double,unit:string,words:array<struct<content:string,confidence:double,polygon:array<float>>>,lines:array<struct<content:string,polygon:array<float>>>,paragraphs:array<struct<content:string,polygon:array<float>>>>>"
    return F.coalesce(F.transform(d["pages"], page), F.array().cast(kind))

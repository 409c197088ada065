"""Tolerant table reading: raw rows out of text, then header detection and access by alias.

Raw rows are ``(source, row_idx, cells)``; nothing is typed and ragged rows are kept. All of it is
column expressions and windows per source, so sources spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import as_column, norm_header, trim_ws

ANCHORS = ("engagement", "engagementdescription", "description", "deal", "opportunity")
_CELL, _ROW, _ESCAPE = "\x01", "\x02", "\x03"


def _escaped(c: Column | str) -> Column:
    """A text in which the marks used for splitting are escaped, so that a cell may hold them."""
    plain = as_column(c)
    marked = plain
    for mark, name in ((_ESCAPE, "3"), (_CELL, "1"), (_ROW, "2")):
        marked = F.replace(marked, F.lit(mark), F.lit(_ESCAPE + name))
    return F.when(plain.rlike("[\x01-\x03]"), marked).otherwise(plain)


def _restored(c: Column) -> Column:
    plain = c
    for mark, name in ((_CELL, "1"), (_ROW, "2"), (_ESCAPE, "3")):
        plain = F.replace(plain, F.lit(_ESCAPE + name), F.lit(mark))
    return F.when(F.contains(c, F.lit(_ESCAPE)), plain).otherwise(c)


def _cells(row: Column) -> Column:
    return F.transform(F.split(row, _CELL, -1), lambda x: _restored(trim_ws(x)))


def quote_count(c: Column | str) -> Column:
    c = as_column(c)
    return F.length(c) - F.length(F.replace(c, F.lit('"')))


def split_csv(c: Column | str) -> Column:
    """Cells of one record: quotes toggle and vanish, commas outside them split, cells are trimmed."""
    parts = F.split(_escaped(c), '"', -1)
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(","), F.lit(_CELL))).otherwise(s)), "")
    return _cells(joined)


def csv_rows(c: Column | str) -> Column:
    """All records of a text as arrays of cells; a record ends at a line end outside quotes."""
    outside = lambda s: F.regexp_replace(F.replace(s, F.lit(","), F.lit(_CELL)), r"\r\n|\r|\n", _ROW)
    inside = lambda s: F.regexp_replace(s, r"\r\n|\r", "\n")
    parts = F.split(_escaped(c), '"', -1)
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, outside(s)).otherwise(inside(s))), "")
    lines = F.split(F.regexp_replace(joined, f"{_ROW}$", ""), _ROW, -1)
    return F.when(F.length(as_column(c)) > 0, F.transform(lines, _cells)).otherwise(F.array().cast("array<array<string>>"))


def exploded(texts: DataFrame, rows: Column, source: str = "source") -> DataFrame:
    return texts.select(F.col(source).alias("source"), F.posexplode(rows).alias("row_idx", "cells")).withColumn("row_idx", F.col("row_idx").cast("long"))


def read_csv_text(texts: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Raw rows of CSV texts, one text per row of ``texts``."""
    return exploded(texts, csv_rows(text), source)


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of CSV files, each read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return read_csv_text(files)


def read_csv_large(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of CSV files of any size, split over tasks.

    Lines are numbered within their input split. Quotes and record starts are counted per split, and each
    split's counts are offset by those before it, so no task sees more than a split, or one record: after a quote that
    never closes the rest of the file is a single record, as it is for :func:`read_csv_files`.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), "value")
    lines = lines.withColumn("quotes", quote_count("value"))
    upto = Window.partitionBy("source", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("seen", F.coalesce(F.sum("quotes").over(upto), F.lit(0)))
    even = F.sum(F.when(F.col("seen") % 2 == 0, 1).otherwise(0))
    odd = F.sum(F.when(F.col("seen") % 2 == 1, 1).otherwise(0))
    per = lines.groupBy("source", "part").agg(F.sum("quotes").alias("quotes"), even.alias("even"), odd.alias("odd"))  # one row per input split
    per = per.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    per = per.withColumn("starts", F.when(F.col("quotes_before") % 2 == 0, F.col("even")).otherwise(F.col("odd")))
    offsets = per.select("source", "part", "quotes_before", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("rows_before"))
    here = Window.partitionBy("source", "part").orderBy("line")
    begins = F.when((F.col("seen") + F.col("quotes_before")) % 2 == 0, 1).otherwise(0)
    placed = lines.join(offsets, ["source", "part"]).withColumn("row_idx", F.sum(begins).over(here) + F.col("rows_before") - 1)
    joined = placed.groupBy("source", "row_idx").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"))  # lines of one record
    return joined.select("source", F.col("row_idx").cast("long").alias("row_idx"), split_csv(F.array_join(F.col("lines.value"), "\n")).alias("cells"))


def ocr_rows(texts: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Raw rows of the ``[TABLE]`` blocks of OCR text, all blocks of a text as one table.

    Separator rows go, and so do later rows equal to the first one ignoring case.
    """
    lines = texts.select(F.col(source).alias("source"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", trim_ws("line"))
    tag = F.lower("line")
    upto = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("inside", F.coalesce(F.last(F.when(tag == "[table]", True).when(tag == "[/table]", False), ignorenulls=True).over(upto), F.lit(False)))
    rows = lines.where(F.col("inside") & F.startswith(F.col("line"), F.lit("|")))
    bare = F.regexp_replace("line", r"^\|+|\|+$", "")
    rows = rows.withColumn("cells", F.transform(F.split(bare, r"\|", -1), trim_ws)).where(~F.forall("cells", lambda c: c.rlike("^[-:]*$")))
    folded = F.transform("cells", F.lower)
    first = F.first(folded).over(Window.partitionBy("source").orderBy("pos"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    kept = rows.withColumn("first", first).withColumn("n", number).where((F.col("n") == 1) | (folded != F.col("first")))
    return kept.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("pos")) - 1).cast("long").alias("row_idx"), "cells")


def with_header(raw: DataFrame, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Data rows with their source's ``headers``: the first row with an anchor name, else the first row.

    Rows above the header and blank rows are dropped.
    """
    names = F.transform("cells", norm_header)
    hit = F.when(F.arrays_overlap(names, F.array(*[F.lit(a) for a in anchors])), F.col("row_idx"))
    found = raw.groupBy("source").agg(F.coalesce(F.min(hit), F.min("row_idx")).alias("header_idx"))
    at = raw.join(found, "source")
    heads = at.where("row_idx = header_idx").select("source", F.col("cells").alias("headers"))
    body = at.where("row_idx > header_idx").where(F.exists("cells", lambda c: F.length(c) > 0))
    return body.join(heads, "source").select("source", "row_idx", "headers", "cells")


def header_index(headers: Column | str, name: str) -> Column:
    """Place of a header from 1, the first of equal names; null if absent or the name is empty."""
    wanted = "".join(name.split()).lower()
    place = F.array_position(F.transform(as_column(headers), norm_header), F.lit(wanted))
    return F.when(F.lit(bool(wanted)) & (place > 0), place)


def cell(headers: Column | str, cells: Column | str, *aliases: str) -> Column:
    """The cell of the first alias whose column exists and reaches into this row (even if empty), else empty."""
    found = [F.get(as_column(cells), (header_index(headers, a) - 1).cast("int")) for a in aliases]
    return F.coalesce(*found, F.lit(""))


def has_column(headers: Column | str, *aliases: str) -> Column:
    names = F.array(*[F.lit("".join(a.split()).lower()) for a in aliases])
    return F.arrays_overlap(F.filter(F.transform(as_column(headers), norm_header), lambda h: h != ""), names)


def wide(table: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """String columns by alias, beside ``source`` and ``row_idx``."""
    return table.select("source", "row_idx", *[cell("headers", "cells", *aliases).alias(name) for name, aliases in columns.items()])

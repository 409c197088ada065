"""Documents from binary files: an injected layout analyzer, else plain text by extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_column
from ..operators.ocr import LAYOUT, page_data, structured_text

TEXT_EXTENSIONS = (".txt", ".csv", ".json", ".xml", ".html", ".md", ".log")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_column(path), r"(\.[^./\\]*)$", 1))


def is_text_file(path: Column | str) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def fallback_text(path: Column | str, content: Column | str) -> Column:
    """Content of a text file, empty for any other."""
    return F.when(is_text_file(path), F.coalesce(F.try_validate_utf8(as_column(content).cast("string")), as_column(content).cast("string"), F.lit(""))).otherwise(F.lit(""))


def analysed(files: DataFrame, analyze: Callable[[bytes], dict[str, Any] | None]) -> DataFrame:
    """``files`` (``path``, ``content``) with ``layout`` from ``analyze``; null where it raised."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    out.append(analyze(bytes(content)))
                except Exception:
                    out.append(None)
            yield b[["path", "content"]].assign(layout=pd.Series(out, index=b.index, dtype=object))

    return files.select("path", "content").mapInPandas(call, f"path string, content binary, layout {LAYOUT}")


def extract(spark: SparkSession, path: str, analyze: Callable[[bytes], dict[str, Any] | None] | None = None) -> DataFrame:
    """``path``, ``text`` and ``pages`` of the files at ``path``.

    Where there is no layout (no analyzer, it raised, or the layout has a table without cells) the text
    falls back to the file's own.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    plain = fallback_text("path", "content")
    empty = page_data(F.lit(None).cast(LAYOUT))
    if analyze is None:
        return files.select("path", plain.alias("text"), empty.alias("pages"))
    found = analysed(files, analyze)
    hollow = F.exists(F.coalesce(F.col("layout.tables"), F.array().cast("array<struct<cells:array<struct<row:int,col:int,content:string>>>>")), lambda t: F.coalesce(F.size(t["cells"]), F.lit(0)) == 0)
    usable = F.col("layout").isNotNull() & ~hollow
    return found.select("path", F.when(usable, structured_text("layout")).otherwise(plain).alias("text"), F.when(usable, page_data("layout")).otherwise(empty).alias("pages"))

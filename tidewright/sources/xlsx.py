"""Spreadsheets as raw rows, read with the standard library: :func:`read_xlsx`, or as a Python data source.

``spark.dataSource.register(XlsxDataSource)``, then ``spark.read.format("tidewright_xlsx").option("path", ...)``
with ``sheet`` for a sheet by name (ignoring case; a missing one raises), else the first. One task per workbook; the data source
reads paths that all workers see as their own.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "source string, row_idx long, cells array<string>"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """Used rows of one sheet as trimmed strings, from the first cell to the last used one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [(s.get("name"), s.get(_REL)) for s in book.iter(f"{_MAIN}sheet")]
        wanted = [r for n, r in sheets if sheet is None or (n or "").lower() == sheet.lower()]
        if not wanted:
            raise ValueError(f"no sheet named {sheet!r}")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[wanted[0]]
        names = z.namelist()
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else k
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    raw = "" if value is None else value.text or ""
                    text = _text(c) if kind == "inlineStr" else shared[int(raw)] if kind == "s" and raw else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else raw
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = text.strip()
                row.clear()
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    yield cells


class _Book(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet = options["path"].removeprefix("file://"), options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.xlsx")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [_Book(p) for p in found]

    def read(self, partition: _Book) -> Iterator[tuple[str, int, list[str]]]:
        with open(partition.path, "rb") as f:
            for k, cells in enumerate(sheet_rows(f.read(), self.sheet)):
                yield partition.path, k, cells


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewright_xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def book_rows(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """Raw rows of workbooks given as ``path`` and ``content``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = list(sheet_rows(bytes(content), sheet))
                yield pd.DataFrame({"source": [path] * len(rows), "row_idx": range(len(rows)), "cells": rows})

    return books.select("path", "content").mapInPandas(read, SCHEMA)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Raw rows of the workbooks at ``path``, in any file system that Spark reads."""
    return book_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), sheet)

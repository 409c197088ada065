import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.sources import documents, tables, xlsx


def csv(spark, text):
    raw = tables.read_csv_text(spark.createDataFrame([("s", text)], "source string, text string"))
    return [r["cells"] for r in raw.orderBy("row_idx").collect()]


def test_csv_records(spark):
    assert csv(spark, 'Customer,Description\nAcme,"one\ntwo"\nB,c\n') == [["Customer", "Description"], ["Acme", "one\ntwo"], ["B", "c"]]
    assert csv(spark, 'a,"x, y\r\nz"\rb') == [["a", "x, y\nz"], ["b"]]
    assert csv(spark, '"Ac ""me""", x ,') == [["Ac me", "x", ""]]
    assert csv(spark, '"open, to\nthe end') == [["open, to\nthe end"]]
    assert csv(spark, "") == [] and csv(spark, "a\n\nb") == [["a"], [""], ["b"]]


def test_csv_files_and_large_files_agree(spark, tmp_path):
    lines = [f'{i},"cell {i}\nwith, a line ""end""",x' if i % 7 == 0 else f"{i},plain,y" for i in range(3000)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    whole = [r["cells"] for r in tables.read_csv_files(spark, str(tmp_path)).orderBy("row_idx").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        split = [r["cells"] for r in tables.read_csv_large(spark, str(tmp_path)).orderBy("row_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(whole) == 3000 and split == whole


def table(spark, rows):
    raw = spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "source string, row_idx long, cells array<string>")
    return tables.with_header(raw)


def test_headers_and_aliases(spark):
    t = table(spark, [["Report"], ["", ""], [" Customer ", "Engagement Description", "", "customer"], ["A", "", "", "z"], ["", ""], ["B"]])
    got = [(r["a"], r["b"], r["c"], r["d"]) for r in t.orderBy("row_idx").select(
        tables.cell("headers", "cells", "missing", "CUSTOMER").alias("a"), tables.cell("headers", "cells", "engagementdescription", "Customer").alias("b"),
        tables.cell("headers", "cells", "").alias("c"), tables.has_column("headers", "x", "Customer").alias("d"),
    ).collect()]
    assert got == [("A", "", "", True), ("B", "B", "", True)]  # an empty cell counts, a short row falls through
    assert table(spark, [["Name", "x"], ["a", "b"]]).first()["headers"] == ["Name", "x"]
    assert table(spark, [["only"]]).count() == 0
    assert tables.with_header(spark.createDataFrame([], "source string, row_idx long, cells array<string>")).count() == 0


OCR = "Title | x\n[TABLE]\n| Partner | Customer |\n|---|:-:|\n| DCH | A |\n| |  |\n[/table]\nnoise\n| not | in |\n [Table] \n| PARTNER | customer |\n| DCH | Del\\|Monte |\nskipped\n"


def test_ocr_tables(spark):
    texts = spark.createDataFrame([("a", OCR), ("b", "no table"), ("c", None)], "source string, text string")
    raw = tables.ocr_rows(texts)
    assert [r["cells"] for r in raw.orderBy("row_idx").collect()] == [["Partner", "Customer"], ["DCH", "A"], ["DCH", "Del\\", "Monte"]]
    assert {r["source"] for r in tables.with_header(raw).collect()} == {"a"}


def book(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t> Deal </t></is></c><c r="C3"><v>43770</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c></row><row r="5"/>'
    book(tmp_path / "b.xlsx", [("First", rows), ("Second", '<row><c t="str"><v>x</v></c></row>')], ["Banner"])
    raw = xlsx.read_xlsx(spark, str(tmp_path / "b.xlsx"))
    assert [r["cells"] for r in raw.orderBy("row_idx").collect()] == [["Banner"], ["Deal", "", "43770"], ["", "TRUE"]]
    assert tables.wide(tables.with_header(raw), {"deal": ("deal",)}).first()["deal"] == ""
    assert xlsx.read_xlsx(spark, str(tmp_path), "SECOND").first()["cells"] == ["x"]
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_xlsx(spark, str(tmp_path), "third").collect()


def analyze(content):
    if content == b"bad":
        raise ValueError("unreadable")
    words = [{"content": "Sure", "confidence": 0.5, "polygon": None}, {"content": "not", "confidence": 0.49, "polygon": None}]
    page = {"page_number": 1, "width": None, "height": 2.0, "unit": None, "words": words, "lines": [{"content": "sure not", "polygon": None}]}
    hollow = [{"cells": []}] if content == b"hollow" else None
    return {"pages": [page], "paragraphs": None, "tables": hollow}


def test_documents(spark, tmp_path):
    for name, content in (("a.pdf", b"x"), ("b.TXT", b"bad"), ("c.pdf", b"bad"), ("d.md", b"hollow")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.extract(spark, str(tmp_path), analyze).collect()}
    assert {k: v["text"] for k, v in got.items()} == {"a.pdf": "sure [?]", "b.TXT": "bad", "c.pdf": "", "d.md": "hollow"}
    assert [p["unit"] for p in got["a.pdf"]["pages"]] == ["inch"] and got["c.pdf"]["pages"] == []
    plain = {r["path"].rsplit("/", 1)[1]: r["text"] for r in documents.extract(spark, str(tmp_path)).collect()}
    assert plain == {"a.pdf": "", "b.TXT": "bad", "c.pdf": "", "d.md": "hollow"}
    assert spark.range(1).select(tables.quote_count(F.lit('a"b""'))).first()[0] == 3


@pytest.mark.parametrize("text", ["a\x01b,c", 'x\x02y,"p\x01,\x02q"\nz\x031,\x03\x03', "\x011\x033,\x02", '"\x03\r\n\x02"'])
def test_cells_keep_control_characters(spark, text):
    df = spark.createDataFrame([("s", text)], "source string, text string")
    rows, row, cell, quoted = [], [], "", False
    for c in text.replace("\r\n", "\n"):
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            row, cell = [*row, cell.strip()], ""
        elif c == "\n" and not quoted:
            rows, row, cell = [*rows, [*row, cell.strip()]], [], ""
        else:
            cell += c
    rows.append([*row, cell.strip()])
    assert [r["cells"] for r in tables.read_csv_text(df).orderBy("row_idx").collect()] == rows
    if len(rows) == 1:
        assert df.select(tables.split_csv("text").alias("c")).first()["c"] == [c.replace("\n", "\r\n") for c in rows[0]]

import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.functions.dates import normalize_dates
from tidewright.functions.text import cache_key, is_blank, norm_header, trim_ws, unfence, url_escape


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column("t").alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_unfence(spark):
    cases = {
        "  {\"a\": 1} ": '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', "```\n[1]\n```": "[1]", "   ": "   ", "": "", None: "",
        'Sure:\n```json\n{"a": 1}\n```': '{"a": 1}', "x ```\nin\n``` tail": "in", "```json\n{\"a\": 1}": '{"a": 1}', "```in```": "in", "```json": "json", " ```": "",
    }
    assert values(spark, list(cases), unfence) == list(cases.values())


def test_trimming_and_names(spark):
    assert values(spark, ["  a b \n", None, "x"], trim_ws) == ["a b", None, "x"]
    assert values(spark, [None, "", "  \t", "a"], is_blank) == [True, True, True, False]
    assert values(spark, [" Engagement  Description\n"], norm_header) == ["engagementdescription"]
    assert values(spark, [None, "b"], lambda c: cache_key(F.lit("a"), c)) == ["a\x1f", "a\x1fb"]
    assert url_escape("a b/c+ü") == "a%20b%2Fc%2B%C3%BC"


@pytest.mark.parametrize(
    ("start", "day"),
    [
        ("2019-11-01", "2019-11-01"), ("2019/11/01", "2019-11-01"), ("03/04/2019", "2019-03-04"), ("3/4/2019", "2019-03-04"), ("27/03/2019", "2019-03-27"), ("27/3/2019", None),
        ("2019-11-01 00:00:00", "2019-11-01"), ("2019-11-01T10:00", "2019-11-01"), ("43770", "2019-11-01"), ("+43770", "2019-11-01"), ("32873", None), ("32874", "1990-01-01"), ("60000", None),
        ("20190101", None), ("2017-27-03", None), ("0001-01-01", None), ("3000-01-01", None), ("2100-12-31", "2100-12-31"), ("", None), (None, None), ("Tue 2019", None), ("-5", None), ("43770.0", None), ("99999999999999", None),
        ("2019-02-30", None), (" 2019-11-01 ", "2019-11-01"), ("13/13/2019", None),
    ],
)
def test_starts(spark, start, day):
    row = spark.createDataFrame([(start,)], "s string").select(normalize_dates("s", F.lit("2001-01-01")).alias("n")).first()["n"]
    assert row["start"] == (datetime.date.fromisoformat(day) if day else None)
    assert row["flag"] == (None if day else "date_invalid") and row["is_active"] is False


def test_ends(spark):
    ends = [None, "", " - ", "TBD", "On-going", "ongoing", "Current", "PRESENT", "2019-01-01", "never"]
    assert values(spark, ends, lambda e: normalize_dates(F.lit("x"), e)["is_active"]) == [True] * 8 + [False] * 2

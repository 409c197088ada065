import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing


def mixed(df):
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized)


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 50), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["d"] == 150 and got[None] == 0
    assert sum(got.values()) == pytest.approx(2060) and got["b"] / got["c"] == pytest.approx(2)


def test_taken_words(spark, docs, empty):
    got = mixed(docs).collect()
    assert len(got) == docs.count()
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = per.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
        t[0] += r["taken"]
        t[2] += r["size"]
    for taken, target, size, source_size in per.values():
        assert abs(taken - target) <= len(per) and target <= 3 * size and size == source_size
    assert sum(t[0] for t in per.values()) == sum(t[3] for t in per.values())  # the whole budget
    again = sorted(map(str, mixed(docs.repartition(5)).select("doc_id", "size", "taken").collect()))
    assert again == sorted(str(r) for r in mixed(docs).select("doc_id", "size", "taken").collect())
    assert mixed(empty).count() == 0


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    assert sorted(map(tuple, mixing.op7_fair_mix(spark, sf_dir).collect())) == want


def test_queue_interleaves_sources_by_weight(spark):
    rows = [(i, "a" if i < 400 else "b", 10) for i in range(800)]
    queue = mixing.fair_queue(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    half = queue.where("finish <= 0.5").groupBy("source").agg(F.sum("words")).collect()
    got = {r[0]: r[1] for r in half}
    assert got["a"] / got["b"] == pytest.approx(2.5, rel=0.05)


def test_queue_is_cut_at_the_budget(spark):
    rows = [(i, f"s{i % 5}", 1 + i * 7 % 90) for i in range(600)] + [(1000, "s1", 9000), (1001, "s4", 20_000)]
    queue = mixing.fair_queue(spark.createDataFrame(rows, "doc_id long, source string, size long")).where("finish is not null").orderBy("position").collect()
    assert [r["finish"] for r in queue] == sorted(r["finish"] for r in queue)
    assert sum(r["words"] for r in queue) == sum(r[2] for r in rows)
    last = max(k for k, r in enumerate(queue) if r["words"])
    assert last < len(queue) - 1 and all(r["words"] > 0 for r in queue[: last + 1]) and queue[last]["finish"] == pytest.approx(1, abs=1e-2)


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, source string, _tw_row string, _tw_times int, row int, times int, `words` int"
    given = [(i, "a b c " * (1 + i), f"s{i % 3}", "r", 1, 2, 3, 4) for i in range(30)]
    out = mixing.mixed_documents(spark.createDataFrame(given, schema))
    assert out.columns == ["doc_id", "text", "source", "_tw_row", "_tw_times", "row", "times", "words"] and {tuple(r) for r in out.collect()} <= set(given)


def test_whole_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id", "text").count().where("doc_id is not null and doc_id <> 0").agg(F.max("count")).first()[0] <= 3

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewright.llm import decontamination as dec


@given(st.lists(st.integers(0, 2**40)))
def test_varint_round_trip(values):
    v = np.array(values, np.int64)
    assert dec.unvarint(dec.varint(v)).tolist() == values


@pytest.fixture(scope="module")
def items(words):
    return [(1, " ".join(words[:14])), (2, " ".join(words[50:70])), (2, " ".join(words[50:70])), (3, "short Item"), (4, None), (5, "--"), (None, " ".join(words[100:111])), (10, " ".join(words[5:16]))]


def rows(df):
    return sorted(map(tuple, df.selectExpr("doc_id", "n_words", "n_hit", "size(item_ids)", "sha2(array_join(item_ids, ','), 256)", "n_hit > 0", "size(near_ids)").collect()), key=str)


def test_against_brute_force(spark, docs, empty, items, words):
    planted = [
        (500, "x " + " ".join(words[2:13]).upper() + ", y", "en", "s", 1, "x", 1, 0.1),
        (501, " ".join(words[50:59]), "en", "s", 1, "x", 1, 0.1),
        (502, "a short item. Short  ITEM " + " - ".join(words[52:66]) + " " + " ".join(words[5:16]), "en", "s", 1, "x", 1, 0.1),
        (503, " ".join(words[100:111]), "en", "s", 1, "x", 1, 0.1),
        (504, "y " + " z ".join(words[58:48:-1]) + " " + " ".join(words[13:2:-1]) + " item and short", "en", "s", 1, "x", 1, 0.1),
    ]
    table = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = rows(dec.contamination(table, bench, shard_bytes=5000))
    assert found == sorted(dec.brute_force([(r["doc_id"], r["text"]) for r in table.collect()], items), key=str)
    assert {r[0] for r in found if r[5]} == {500, 502, 503} and {r[0]: r[6] for r in found}[504] == 2
    left = dec.clean(table, bench)
    assert left.columns == table.columns and left.count() == table.count() - 3
    assert dec.contamination(empty, bench).count() == 0
    assert dec.contamination(table, bench.where("false")).where("n_hit > 0").count() == 0


def test_blocks_of_items_agree(spark, docs, items, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = rows(dec.contamination(docs, bench))
    monkeypatch.setattr(dec, "ITEM_BYTES", 100)
    assert rows(dec.contamination(docs, bench)) == whole


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    index = dec.build_index(docs)
    found = dec.search(index, ["alpha beta gamma"], proximity=5)
    assert {(r["doc_id"], r["start"]) for r in found.collect()} == {(1, 0), (3, 0)}
    assert {r["doc_id"] for r in dec.search(index, ["gamma beta"]).collect()} == {3}
    assert {(r["doc_id"], r["phrase"], r["start"]) for r in dec.search(index, ["gamma", "", "beta", "gamma"]).collect()} == {(d, p, s) for d, g, b in ((1, 4, 2), (2, 32, 31), (3, 0, 1)) for p, s in ((0, g), (2, b), (3, g))}


def test_proximity_stays_in_a_document_and_a_run():
    first, count = np.array([0, 3, 6]), np.array([3, 3, 4])
    assert dec.near([np.array([2, 4]), np.array([3, 5, 9])], 3, first, count).tolist() == [3, 4]
    assert dec.near([np.array([3]), np.array([2, 6, 8])], 5, first, count).tolist() == []
    one = np.array([0]), np.array([20])
    assert dec.near([np.array([5]), np.array([2]), np.array([8])], 4, *one).tolist() == [] and dec.near([np.array([5]), np.array([2]), np.array([8])], 7, *one).tolist() == [2]


@pytest.mark.parametrize("shard_bytes", [4, 60, 1 << 20])
def test_proximity_is_independent_of_sharding(spark, shard_bytes):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(60)] + ["one foo", "bar two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    phrases = ["a b c", "h g", "foo bar", "a a b"]
    want = {(d, k, s) for d, t in enumerate(texts) for k, p in enumerate(phrases) for s, w in enumerate(t.split()) if w in p.split() and set(p.split()) <= set(t.split()[s : s + 5])}
    assert {tuple(r) for r in dec.search(dec.build_index(docs, shard_bytes=shard_bytes), phrases, proximity=5).collect()} == want


def test_neighbouring_documents_make_no_match(spark):
    docs = spark.createDataFrame([(i, ("alpha x", "beta y", "x alpha", "y beta")[i % 4]) for i in range(40)] + [(99, "beta x alpha")], "doc_id long, text string").coalesce(1)
    index = dec.build_index(docs)
    assert {r["doc_id"] for r in dec.search(index, ["alpha beta"], proximity=5).collect()} == {99}
    assert dec.search(index, ["x beta", "alpha x x"]).count() == 0


def test_words_that_polynomials_confuse(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    docs = [(1, f"{one} x"), (2, f"{two} x")]
    assert rows(dec.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, f"{one} x")], "item_id long, text string"))) == sorted(dec.brute_force(docs, [(7, f"{one} x")]), key=str)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "k", "r"), (2, "d e", None, None), (2, None, "x", "y")], "doc_id long, text string, _tw_row string, row string")
    left = dec.clean(docs, spark.createDataFrame([(1, "d e")], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(map(str, docs.where("text is null or text = 'a b c'").collect()))

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import packing


def naive(lengths, capacity):
    """Best fit decreasing by looking at every open sequence."""
    room, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            k = room.index(min(fits))
        else:
            room.append(capacity)
            bins.append([])
            k = len(room) - 1
        room[k] -= lengths[i]
        bins[k].append(i)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=40))
def test_best_fit(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    bins = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(p for b in bins for p in b) == list(range(len(lengths)))
    assert all(sum(lengths[p] for p in b) <= capacity for b in bins)
    # which of several sequences with equal room a piece goes to is free, so their sums are those of the naive fit
    assert sorted(sum(lengths[p] for p in b) for b in bins) == sorted(sum(lengths[p] for p in b) for b in naive(lengths, capacity))


def test_round_trip(spark, docs, empty, tmp_path):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack(own, bucket_bytes=1 << 14, capacity=512)
    rows = [r.asDict() for r in packed.collect()]
    assert {k: v.decode() for k, v in packing.unpacked(rows).items()} == {r["doc_id"]: r["text"] or "" for r in own.collect()}
    assert len({r["bucket"] for r in rows}) > 1
    for r in rows:
        cu, places = r["cu_seqlens"], np.frombuffer(r["positions"], "<u2")
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 512 and len(r["ids"]) == 1024
        assert all(places[a] == 0 and places[b - 1] == b - a - 1 for a, b in zip(cu, cu[1:], strict=False))
    files = packing.write_matrices(packed, f"file://{tmp_path}/ids", 512).collect()
    assert sum(np.load(f["file"]).shape[0] for f in files) == len(rows)
    again = [r.asDict() for r in packing.pack(own.repartition(7), bucket_bytes=1 << 14, capacity=512).collect()]
    order = lambda rs: sorted(rs, key=lambda r: (r["bucket"], r["seq"]))
    assert order(rows) == order(again)
    assert packing.pack(docs, capacity=512).where("true").selectExpr("sum(size(doc_ids))").first()[0] >= docs.count()
    assert packing.pack(empty).count() == 0


def test_repeated_rows_are_spread(spark):
    rows = [(7, "the same text again and again " * 3)] * 3000 + [(i, f"text {i}") for i in range(100, 160)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bucket_bytes=1 << 14, capacity=256)
    per = packed.selectExpr("bucket", "explode(doc_ids) as d").where("d = 7").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in per) == 3000 and len(per) > 10 and max(r["count"] for r in per) < 400
    assert packed.selectExpr("explode(doc_ids) as d").count() == len(rows)


def test_long_text_and_whole_query(spark, sf_dir):
    text = "some words of a long text, " * 60_000
    packed = packing.pack(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"))
    assert {k: v.decode() for k, v in packing.unpacked(r.asDict() for r in packed.collect()).items()} == {1: text, 2: "x"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in packing.op2_best_fit_packing(spark, sf_dir).collect()]
    assert {k: v.decode() for k, v in packing.unpacked(rows).items()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lengths, encoding = [], packing.tokenizer()[0]
    for r in docs.collect():
        n = len(encoding.encode(r["text"] or "", disallowed_special=())) + 1
        lengths += [min(2048, n - a) for a in range(0, n, 2048)]
    if len({r["bucket"] for r in rows}) == 1:
        assert sorted(r["n_tokens"] for r in rows) == sorted(sum(lengths[p] for p in b) for b in naive(lengths, 2048))


def test_ids_of_large_vocabularies():
    assert packing.id_kind(65_535) == "<u2" and packing.id_kind(65_536) == "<u4"

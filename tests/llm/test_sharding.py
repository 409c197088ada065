import zlib

import numpy as np

from tidewright.llm import sharding


def test_fisher_yates_permutes():
    assert sorted(sharding.fisher_yates(1000, 3).tolist()) == list(range(1000))
    assert sharding.fisher_yates(1000, 3).tolist() == sharding.fisher_yates(1000, 3).tolist() != sharding.fisher_yates(1000, 4).tolist()
    assert sharding.fisher_yates(0, 1).tolist() == []


def test_shards(spark, docs, empty, tmp_path):
    out = sharding.external_shuffle(docs, bucket_bytes=20_000)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    slots = {}
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    again = sharding.external_shuffle(docs.repartition(6), bucket_bytes=20_000).select("doc_id", "text_crc32", "shard", "slot")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.select("doc_id", "text_crc32", "shard", "slot").collect()))
    back = sharding.write_shards(out, f"{tmp_path}/shards")
    assert back.columns == out.columns and sorted(map(str, back.collect())) == sorted(map(str, rows))
    assert spark.read.parquet(f"{tmp_path}/shards/shard=3").count() == counts[3]
    assert sharding.external_shuffle(empty).count() == 0


def brute_force(rows, buckets, bucket_of, seed=sharding.SEED, shards=8):
    """The same one row after the other, with a swapping shuffle of each bucket's rows."""
    stream = []
    for b in range(buckets):
        own = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows if bucket_of[d, t] == b)
        draw = np.random.Generator(np.random.PCG64(seed * 1_000_003 + b)).integers(0, np.arange(len(own), 0, -1), dtype=np.int64).tolist() if own else []
        for k, j in zip(range(len(own) - 1, -1, -1), draw, strict=True):
            own[k], own[j] = own[j], own[k]
        stream += own
    return sorted((d, size, crc, k % shards, k // shards) for k, (d, crc, size) in enumerate(stream))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    for given, limit in ((sharding.op9_two_pass_shuffle(spark, sf_dir), sharding.BUCKET_BYTES), (sharding.external_shuffle(docs, bucket_bytes=20_000), 20_000)):
        buckets = -(-total // limit)
        crc = sharding.F.crc32(sharding.F.coalesce("text", sharding.F.lit("")).cast("binary"))
        of = sharding.F.pmod(sharding.F.xxhash64(sharding.F.lit(sharding.SEED), "doc_id", crc, sharding.F.lit(0).cast("long")), sharding.F.lit(buckets))
        bucket_of = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", of).collect()}
        assert sorted(tuple(r) for r in given.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == brute_force(rows, buckets, bucket_of)


def test_repeated_rows_are_spread_and_names_kept(spark):
    schema = "doc_id long, text string, _tw_bucket string, bucket int, copy int, Offset int, SLOT int"
    rows = [(7, "the same text again and again " * 3, "b", 1, 2, 3, 4)] * 3000 + [(7, "the same text again and again " * 3, "c", 1, 2, 3, 4)] * 2 + [(i, None, None, i, 0, 0, 0) for i in range(60)]
    out = sharding.external_shuffle(spark.createDataFrame(rows, schema).repartition(4), bucket_bytes=1 << 14)
    assert out.columns == ["doc_id", "text", "_tw_bucket", "bucket", "copy", "Offset", "size", "text_crc32", "shard", "slot", "stream_pos"]
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (r[:6] for r in rows)))
    assert sorted(r["stream_pos"] for r in got) == list(range(len(rows)))
    again = out.select("doc_id", "_tw_bucket", "stream_pos").collect()
    assert sorted(map(str, again)) == sorted(map(str, sharding.external_shuffle(spark.createDataFrame(rows, schema).repartition(2), bucket_bytes=1 << 14).select("doc_id", "_tw_bucket", "stream_pos").collect()))

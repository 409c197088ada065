import math
import re

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def mixed(docs, key, weights=(5, 2, 1), cap=3):
    """How often the fair queue serves each whole document, by plain loops; ``docs`` are (doc_id, text, source), ``key`` their seeded order."""
    size = {d: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    of = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    budget, full, goal = sum(of.values()), set(), {}
    while True:
        rest = [s for s in sources if s not in full]
        level = (budget - sum(cap * of[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if weight[s] * level > cap * of[s]}
        if not over:
            break
        full |= over
    goal = {s: cap * of[s] if s in full else weight[s] * level for s in sources}
    queue = []
    for rank, s in enumerate(sources):
        at = 0
        own = sorted((key[d], d) for d, _, x in docs if x == s)
        for turn in range(cap):
            for order, d in own:
                n = size[d]
                if n and at <= goal[s]:
                    now = min(n, max(0, math.floor(goal[s] + 0.5) - at))
                    for words, finish in ((now, 1.0 if now < n else (at + n) / goal[s]), (n - now, (at + n) / goal[s])):
                        if words:
                            queue.append((finish, rank, order, turn, d, words))
                at += n
    left, taken = budget, {}
    for _, _, _, turn, d, words in sorted(queue):
        taken[d, turn] = taken.get((d, turn), 0) + min(words, left)
        left -= min(words, left)
    times = {}
    for (d, _), words in taken.items():
        times[d] = times.get(d, 0) + (2 * words >= size[d])
    return {d: n for d, n in times.items() if n}


def test_stages(spark, sf_dir, pipeline):
    """Every document of the result by brute force, past the network's own verdicts."""
    from tidewright.llm import decontamination, mixing, neardup, toxicity
    from tidewright.llm.scratch import row_key

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pipeline.run(spark, sf_dir)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    first = toxicity.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "text").collect()
    kept = {d for d, _, _, k in neardup.brute_force([tuple(r) for r in first]) if k}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in decontamination.brute_force([tuple(r) for r in first if r[0] in kept], bench) if not r[5]}
    left = [(r["doc_id"], r["text"], source[r["doc_id"]]) for r in first if r["doc_id"] in clean]
    shuffled = F.md5(F.concat_ws(":", F.lit(mixing.SEED), row_key().cast("string")))
    key = {r[0]: r[1] for r in docs.select("doc_id", shuffled).collect()}
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == mixed(left, key)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(k, [])) for k in range(8)]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(counts) - min(counts) <= 1


def test_odd_rows(spark, pipeline, docs, empty, tmp_path):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, given in (("a", docs), ("b", empty)):
        now = given
        for k, (stage, f) in enumerate(pipeline.STAGES):
            f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert set(given.columns) <= set(now.columns) or stage == "sharding"
        assert (now.count() > 0) == (name == "a")

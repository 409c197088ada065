import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import neardup


def near_texts(words, seed=3):
    """Copies, near copies around the threshold, chains, and a group of hundreds of variants."""
    rng = random.Random(seed)
    base = rng.choices(words, k=120)
    out = [" ".join(base)] * 3 + [" ".join(base).upper()]
    for changes in range(1, 9):
        for _ in range(4):
            own = list(base)
            for k in rng.sample(range(len(own)), changes):
                own[k] = rng.choice(words)
            out.append(" \t".join(own))
    chain = rng.choices(words, k=80)
    for k in range(12):
        out.append(" ".join(chain))
        chain = chain[2:] + rng.choices(words, k=2)
    hot = rng.choices(words, k=60)
    out += [" ".join(hot + [f"id{k}"]) for k in range(250)]
    for n in range(1, 12):
        short = rng.choices(words, k=n)
        out += [" ".join(short), " ".join(short), " ".join([*short, "end"])]
    return out


def test_estimate_is_close(words):
    rng = random.Random(1)
    a = rng.choices(range(10**9), k=900)
    for share in (0.5, 0.85, 0.95):
        b = a[: int(len(a) * share)] + rng.choices(range(10**9), k=int(len(a) * (1 - share)))
        sets = [np.unique(np.array([hash((x, 7)) & (2**64 - 1) for x in s], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (a, b)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        got, _ = neardup.estimate(neardup.registers(sets[0])[None], neardup.registers(sets[1])[None])
        assert abs(got[0] - true) < 0.1


def compared(df):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(df).collect()]
    return sorted(got, key=str), sorted(neardup.brute_force([(r["doc_id"], r["text"]) for r in df.collect()]), key=str)


def test_against_brute_force(spark, words):
    rows = [(i, t) for i, t in enumerate(near_texts(words))]
    random.Random(1).shuffle(rows)
    got, want = compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == want


def test_odd_rows(docs, empty):
    named = docs.where("doc_id is not null")
    got, want = compared(named)
    assert got == want
    assert neardup.groups(docs).count() == docs.count()
    assert neardup.groups(empty).count() == 0
    once = neardup.one_of_each(named)
    assert once.columns == named.columns
    kept = {w[0] for w in want if w[3]}
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(kept)
    nameless = docs.limit(0).sparkSession.createDataFrame([(None, "one two three four"), (None, "five six seven"), (None, "five six seven"), (None, ""), (None, None)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in neardup.one_of_each(nameless).collect()) == ["", "None", "five six seven", "one two three four"]


def test_no_collisions_can_be_made(spark):
    """Thue-Morse words and their complements collide under polynomial hashes modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, one), (4, two), (5, one), (6, one[:24] + " tail word"), (7, two[:24] + " tail word")]
    got, want = compared(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want and {r[0]: r[2] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7}


def test_links_are_confirmed_on_words(monkeypatch):
    """Even if all words of a length had one hash."""
    monkeypatch.setattr(neardup.wb, "hashes", lambda buf, s, e, key=0: (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b, c = neardup.full_sets(pa.array(["aa bbb cccc ddddd", "xx yyy zzzz wwwww", "AA bbb cccc ddddd"]))
    assert np.array_equal(a.hashes, b.hashes) and not neardup.linked(a, b) and neardup.linked(a, c)


def test_many_unlinked_classes_in_one_bucket(spark, words, monkeypatch):
    """5,000 documents that share most of one band's registers, and two that are linked among them."""
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup, "BANDS", 1)
    rng = random.Random(12)
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(5000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9001, texts[17] + " more"), (9002, texts[4321] + " other tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(df).collect()}
    assert all(got[i] == i for i in range(5000)) and {got[9001], got[9002]} <= {17, 4321, 9001, 9002}


def test_repeated_rows_with_other_columns_and_clashing_names(spark):
    schema = "doc_id long, text string, key string, `group` int, row string, Row_ int, _tw_key string"
    rows = [(1, "one two three", b, a, "r", 3, "t") for a in (1, 2) for b in ("x", "y")] + [(2, "one two three", "z", 0, "r", 1, "t"), (3, None, "z", 0, "r", 1, "t"), (3, "", "z", 0, "r", 1, "t")]
    docs = spark.createDataFrame(rows, schema.replace("Row_ int", "Key_ int"))
    for parts in (1, 3):
        kept = neardup.one_of_each(docs.repartition(parts))
        assert kept.columns == docs.columns
        assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[5], rows[6]]))


@pytest.mark.parametrize("block", [5, 512])
def test_crowded_buckets_are_compared_whole(spark, words, monkeypatch, block):
    """One band of one register puts everything in few buckets; links must still be all found."""
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup, "BANDS", 3)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    rng = random.Random(9)
    base = rng.choices(words, k=3000)  # no register of theirs is empty, whatever the key
    texts = []
    for k in range(60):
        own = list(base)
        for j in rng.sample(range(3000), 15 * (1 + k % 6)):
            own[j] = rng.choice(words)
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = neardup.groups(df)
    got = {(r["doc_id"], r["component_id"]) for r in groups.collect()}
    want = {(d, c) for d, _, c, _ in neardup.brute_force(list(enumerate(texts)))}
    assert len(got - want) <= 2  # a pair may share none of three bands


def test_a_shared_phrase_is_no_candidate(spark, words):
    """Short texts with one phrase in common share no bucket by it alone; before, 27,867 pairs did."""
    rng = random.Random(21)
    texts = [" ".join([*rng.choices(words, k=12), "under", "this", "licence", *rng.choices(words, k=12)]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = neardup._bands(neardup.sketch(docs, 5)).groupBy("band").count()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in bands.collect()) < 400


def test_a_bucket_of_variants_passes_a_pair_each(spark, words):
    """Variants of a text that are all likely pairs: as many pairs as connect them, not the 1,711 of before."""
    rng = random.Random(22)
    base = rng.choices(words, k=300)
    docs = spark.createDataFrame([(k, " ".join([*base, f"id{k}"])) for k in range(60)], "doc_id long, text string")
    classes = neardup.sketch(docs, 5).cache()
    placed = classes.selectExpr("64L AS band", "cls", "cls AS root")
    pairs = [(bytes(r["a"]), bytes(r["b"])) for r in neardup._across(placed, classes).collect()]
    assert len(pairs) == 59
    near = {pairs[0][0]}
    for _ in pairs:
        near |= {x for p in pairs if near & {*p} for x in p}
    assert len(near) == 60


def test_joined_connects_what_links_connect(words):
    texts = near_texts(words)
    random.Random(3).shuffle(texts)
    sets = list(neardup.full_sets(pa.array(texts), 9))
    found = neardup.joined(sets)
    root = list(range(len(sets)))
    for a, b in found:
        assert neardup.linked(sets[a], sets[b]) and root[a] != root[b]  # no pair twice, none that others connect
        root = [root[b] if r == root[a] else r for r in root]
    want = [c for _, _, c, _ in neardup.brute_force(list(enumerate(texts)))]
    assert len(set(zip(root, want, strict=True))) == len(set(root)) == len(set(want))


def test_filled_registers_agree_as_sets_do():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 2**64, (300, 34), np.uint64)
    of = lambda part: neardup.filled(np.array([neardup.registers(np.sort(x)) for x in part]))
    a, b = of(h[:, :32]), of(h[:, 2:])
    assert a.all() and abs((a == b).mean() - 30 / 34) < 0.01
    assert not neardup.filled(np.zeros((1, 256), np.uint8)).any()

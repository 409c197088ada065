import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import toxicity as tox

BAD = ["florgish", "quibbler", "snarkfen"]


def corpus(words, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(5, 150))
        if i % 4 == 0:
            for _ in range(3):
                body.insert(rng.randrange(len(body) + 1), rng.choice(BAD[:2]) if rng.random() < 0.5 else BAD[2] + rng.choice(["er", "ing", "ed", "s", "ly"]))
        out.append((" ".join(body), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def network(words):
    return tox.fit(*map(list, zip(*corpus(words, 900, 1), strict=True)))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tox.initial(rng).items()}
    feats, ptr = tox._read(["the cat sat", "", "a b c d e " * 9])
    start, end, _ = tox.windows(ptr)
    x, y = tox.embed(p, feats).astype(np.float64), np.arange(len(start)) % 2
    old, tox.f4 = tox.f4, np.float64
    try:
        _, grads, dx = tox.gradients(p, x, start, end, y)
        for k in ("u_f", "u_b", "att_f", "out_b", "bias", "w_b", "c_f"):
            at = tuple(min(1, n - 1) for n in p[k].shape)
            p[k][at] += 1e-5
            up = tox.gradients(p, x, start, end, y)[0]
            p[k][at] -= 2e-5
            down = tox.gradients(p, x, start, end, y)[0]
            p[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - grads[k][at]) < 2e-4
    finally:
        tox.f4 = old
    assert dx.shape == x.shape


def test_windows_cover_every_word():
    ptr = np.cumsum([0, 0, 1, tox.WINDOW, tox.WINDOW + 1, 5 * tox.WINDOW + 3])
    start, end, first = tox.windows(ptr)
    for i in range(len(ptr) - 1):
        seen = set()
        for w in range(first[i], first[i + 1]):
            seen |= set(range(start[w], end[w]))
        assert seen == set(range(ptr[i], ptr[i + 1])) and first[i + 1] > first[i]


def test_held_out_accuracy(network, words):
    texts, y = map(list, zip(*corpus(words, 400, 2), strict=True))
    predicted = tox.score_column(network, pa.array(texts)) >= tox.THRESHOLD
    assert (predicted == np.array(y, bool)).mean() > 0.97


def test_blocks_and_long_texts_score_alike(network, words):
    long = " ".join(random.Random(3).choices(words, k=30_000))
    texts = [None, "", long, long + " florgish quibbler florgish", "florgish quibbler"]
    whole = tox.score_column(network, pa.array(texts))
    each = [tox.score_column(network, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(whole, each, atol=1e-5) and whole[0] == whole[1]
    assert whole[3] > tox.THRESHOLD > whole[1] and ((whole >= 0) & (whole <= 1)).all()


def test_every_gram_of_a_long_run_counts(network):
    run = "漢字かな交じり文の長い一続きと" + "anothersomewhatlongcompound"
    have = set(tox._read([run])[0]["gram"].ravel().tolist())
    code = run.encode()
    for size, mark in ((4, 40), (5, 42)):
        for k in range(len(code) - size + 1):
            gram = np.array([int.from_bytes(code[k : k + size], "little") + (1 << mark)], np.uint64)
            with np.errstate(over="ignore"):
                assert int(tox.wb.mix(gram)[0] >> np.uint64(64 - tox.GRAM_BITS)) in have
    plain, glued = tox.score_column(network, pa.array([" ".join(["abelcomdarhen" + t + "tirmosu"] * 3) for t in ("ghilmono", BAD[2])]))
    assert glued > plain


def test_words_end_at_typographic_marks(network):
    a, b, c = tox.score_column(network, pa.array(["a bel…florgish—quibbler“florgish”", "a bel florgish quibbler florgish", "a\u3000bel、florgish。quibbler\u00a0«florgish»"]))
    assert a == b == c > tox.THRESHOLD
    assert len(tox._read(["foo\u200bbar"])[0]["word"]) == 1


def test_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(1, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for given in (labels, none):
        got = tox.scored(docs, given)
        assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert tox.scored(empty, labels).count() == 0
    kept = tox.not_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()

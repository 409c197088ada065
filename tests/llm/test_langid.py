import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import langid

SYLLABLES = {"xx": ["tha", "ing", "wo", "the"], "yy": ["sch", "ein", "über", "keit"], "zz": ["eau", "que", "é", "tion"], "ru": ["при", "вет", "как", "дом"]}


def text_of(lang, n, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    pairs = [(text_of(k, rng.randint(5, 80), rng), k) for k in SYLLABLES for _ in range(60)]
    return langid.learn(*map(list, zip(*pairs, strict=True)))


def one_pass(scores, penalty):
    v, back = np.zeros(scores.shape[1]), []
    for s in scores:
        m = v.max() - penalty
        back.append(np.where(v < m, v.argmax(), np.arange(len(v))))
        v = np.maximum(v, m) + s
    state, out = v.argmax(), []
    for b in reversed(back):
        out.append(state)
        state = b[state]
    return out[::-1]


def test_viterbi_in_chunks_is_one_pass():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 63, 64, 65, 200, 0, 300]
    ptr = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(0, 2, (ptr[-1], 4)).astype(np.float32)
    got = langid.viterbi(scores, ptr, 3.0)
    for a, b in zip(ptr, ptr[1:], strict=False):
        assert got[a:b].tolist() == one_pass(scores[a:b], 3.0)


def test_held_out_accuracy(model):
    rng = random.Random(7)
    pairs = [(text_of(k, rng.randint(5, 60), rng), k) for k in SYLLABLES for _ in range(50)]
    lang, score = langid.predict(model, pa.array([t for t, _ in pairs]))
    assert np.mean([a == b for a, (_, b) in zip(lang, pairs, strict=True)]) > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_spans_of_mixed_text(model):
    rng = random.Random(8)
    a, b = text_of("xx", 30, rng), text_of("ru", 30, rng)
    spans = langid.language_spans(model, f"{a} {b}")
    assert [s[2] for s in spans] == ["xx", "ru"] and spans[1][0] == len(a) + 1 and spans[1][1] == len(a) + 1 + len(b)


def test_texts_without_letters(model):
    lang, score = langid.predict(model, pa.array(["", None, "12 — !", "\n"]))
    assert lang == ["und"] * 4 and not score.any()
    assert langid.predict(None, pa.array(["abc"]))[0] == ["und"]


def test_many_languages(spark):
    rng = random.Random(3)
    names = [f"l{i:02d}" for i in range(12)]
    table = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(4)] for n in names}
    make = lambda n: " ".join("".join(rng.choices(table[n], k=2)) for _ in range(30))
    pairs = [(make(n), n) for n in names for _ in range(20)]
    model = langid.learn(*map(list, zip(*pairs, strict=True)))
    test = [(make(n), n) for n in names for _ in range(5)]
    assert np.mean([a == n for a, (_, n) in zip(langid.predict(model, pa.array([t for t, _ in test]))[0], test, strict=True)]) > 0.95


def test_rows(docs, empty):
    got = langid.identified(docs, langid.train(docs))
    assert got.count() == docs.count() and got.where("lang_pred is null or score is null").count() == 0
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "und"}
    assert langid.identified(empty, langid.train(empty)).count() == 0


def test_every_language_of_a_mixed_text():
    rng = random.Random(5)
    names = [f"l{i:02d}" for i in range(12)]
    table = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(6)] for n in names}
    make = lambda n, k: " ".join("".join(rng.choices(table[n], k=2)) for _ in range(k))
    model = langid.learn(*map(list, zip(*[(make(n, 40), n) for n in names for _ in range(20)], strict=True)))
    text = " ".join(make(n, 40) for n in names)
    assert [s[2] for s in langid.language_spans(model, text)] == names


def test_viterbi_with_many_states(monkeypatch):
    rng = np.random.default_rng(1)
    ptr = np.array([0, 0, 7, 400, 530])
    scores = rng.normal(0, 2, (530, 300)).astype(np.float32)
    for limit in (64 << 20, 1 << 20):
        monkeypatch.setattr(langid, "ACROSS_BYTES", limit)
        got = langid.viterbi(scores, ptr, 3.0)
        for a, b in zip(ptr, ptr[1:], strict=False):
            assert got[a:b].tolist() == one_pass(scores[a:b], 3.0)

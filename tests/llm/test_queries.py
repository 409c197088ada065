"""The registered queries on whole tables: columns and types, DuckDB equivalents, and plain loops where SQL can't express them."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_personal_data import naive

from tidewright.llm import personal_data, queries, toxicity

COLUMNS = {
    "op1": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4": "page_id bigint, url string, text string, n_chars bigint",
    "op5": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6": "query_id bigint, rank int, vec_id bigint, score double",
    "op7": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, queries.queries()[name](spark, sf_dir).select(*columns).toArrow().to_pylist())) == sorted(str(dict(zip(columns, r, strict=True))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns(spark, sf_dir, name):
    short = name.split("_")[0]
    if short in COLUMNS:
        types = dict(queries.queries()[name](spark, sf_dir).dtypes)
        for part in COLUMNS[short].split(", "):
            column, kind = part.split(" ")
            assert types[column] == kind, column


def test_plain_spans_of_all_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in personal_data.op1_deobfuscated_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base = naive(text or "")
        assert got[doc_id]["base_sha256"] == hashlib.sha256(personal_data.joined(base).encode()).hexdigest()
        assert set(personal_data.joined(base).split(",")) <= set(got[doc_id]["spans"].split(",")) | {""}
        assert got[doc_id]["spans"] == personal_data.joined(base + personal_data.added_spans(text or "", base))


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.queries()["op10_viterbi_language"](spark, sf).collect()}
    right = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        one = got[r["doc_id"]]
        assert one["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (one["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
        if one["held_out"] and r["lang"] is not None and one["lang_pred"] != "und":
            right.append(one["lang_pred"] == r["lang"])
    assert len(right) > 200 and np.mean(right) > 0.97


def test_toxicity_of_all_documents(spark, sf_dir):
    rows = toxicity.op3_recurrent_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def plain_score(p, text):
    """A window's logit one word and one unit after the other, in double precision."""
    x = toxicity.embed(p, toxicity._read([text])[0]).astype(float)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    attention, value = np.zeros(len(x)), np.zeros(len(x))
    size = toxicity.HIDDEN
    for d in "fb":
        w, u, c = (p[f"{k}_{d}"].astype(float) for k in "wuc")
        h = np.zeros(size)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            new = np.zeros(size)
            for j in range(size):
                a = [sum(x[t][i] * w[i, k] for i in range(len(x[t]))) + c[k] for k in (j, size + j, 2 * size + j)]
                b = [sum(h[i] * u[i, k] for i in range(size)) for k in (j, size + j, 2 * size + j)]
                z, r = sigmoid(a[0] + b[0]), sigmoid(a[1] + b[1])
                new[j] = (1 - z) * np.tanh(a[2] + r * b[2]) + z * h[j]
            h = new
            attention[t] += sum(h * p[f"att_{d}"])
            value[t] += sum(h * p[f"out_{d}"])
    share = np.exp(attention - attention.max())
    return float((share * value).sum() / share.sum() + p["bias"][0])


def test_scores_against_plain_loops(words):
    rng = random.Random(11)
    p = toxicity.initial(np.random.default_rng(4))
    for n in (1, 5, 31, 32):
        text = " ".join(rng.choices(words, k=n))
        feats, ptr = toxicity._read([text])
        start, end, _ = toxicity.windows(ptr)
        assert abs(toxicity.logits(p, toxicity.embed(p, feats), start, end)[0] - plain_score(p, text)) < 1e-4
    long = " ".join(rng.choices(words, k=90))
    feats, ptr = toxicity._read([long])
    start, end, _ = toxicity.windows(ptr)
    assert len(ptr) == 2 and ptr[1] == 90
    want = [plain_score(p, " ".join(long.split(" ")[a:b])) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    assert np.allclose(toxicity.logits(p, toxicity.embed(p, feats), start, end), want, atol=1e-4)
    assert (start[1:] - start[:-1] <= toxicity.STRIDE).all() and end[-1] == 90

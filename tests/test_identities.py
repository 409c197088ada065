import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from tidewright.operators import pseudonyms, tokens
from tidewright.streaming.keystore import register_stream

KEY = bytes([7] * 32)


def identities(spark, rows):
    return pseudonyms.identity_map(spark.createDataFrame(rows, "ordinal long, kind string, name string"))


def test_numbering(spark):
    rows = [(1, "account", " Acme "), (2, "account", "ACME"), (3, "partner", "Acme"), (4, "account", " "), (5, "account", None), (6, "account", "Beta")]
    got = {(r["kind"], r["real"], r["token"]) for r in identities(spark, rows).collect()}
    assert got == {("ACCOUNT", "Acme", "ACCOUNT_01"), ("PARTNER", "Acme", "PARTNER_01"), ("ACCOUNT", "Beta", "ACCOUNT_02")}
    many = identities(spark, [(i, "vendor", f"v{i}") for i in range(1, 130)])
    assert many.where("real = 'v123'").first()["token"] == "VENDOR_123"
    assert pseudonyms.identity_count(many).first()[0] == 129
    named = spark.createDataFrame([(1, "acme"), (2, "  "), (3, None), (4, "unknown")], "i int, name string")
    out = pseudonyms.anonymize(named, identities(spark, rows), "account", "name", "t")
    assert {r["i"]: r["t"] for r in out.collect()} == {1: "ACCOUNT_01", 2: "", 3: "", 4: None}


def test_scrub_and_hydrate(spark):
    session = identities(spark, [(1, "account", "Acme (EU)"), (2, "partner", "Acme"), (3, "vendor", "abc"), (4, "vendor", r"x\Ey.z")])
    texts = spark.createDataFrame([(1, "To ACME (eu), acmeville, abc and X\\ey.z; xEy.z"), (2, None), (3, "")], "i int, t string")
    out = pseudonyms.scrub(texts, session, "t", "s")
    assert {r["i"]: r["s"] for r in out.collect()} == {1: "To ACCOUNT_01, PARTNER_01ville, abc and VENDOR_02; xEy.z", 2: None, 3: ""}
    many = identities(spark, [(i, "account", f"name {i}.") for i in range(1, 101)])
    text = spark.createDataFrame([("ACCOUNT_100 ACCOUNT_10 account_10",)], "t string")
    assert pseudonyms.hydrate(text, many, "t", "h").first()["h"] == "name 10.0 name 10. account_10"
    assert pseudonyms.hydrate(text, many, "t", "h", longest_first=True).first()["h"] == "name 100. name 10. account_10"


def values(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, token_type string, real string, at long")


def test_register_and_reveal(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = values(spark, [("acme", "Account", "ABP Corporation", 1), ("acme", "ACCOUNT", " abp corporation ", 2), ("acme", "Account", " ", 3), ("globex", "Account", "ABP Corporation", 4)])
    first = {(r["tenant_id"], r["real"]): r["token"] for r in tokens.register(rows, path, KEY, "at").collect()}
    assert len(first) == 3 and first["acme", "ABP Corporation"] == first["acme", " abp corporation "] != first["globex", "ABP Corporation"]
    assert tokens.register(rows, path, KEY, "at").count() == 3
    store = tokens.read_store(spark, path)
    assert store.count() == 2
    for r in store.collect():
        assert "abp" not in (r["real_value_encrypted"] + r["real_value_hash"]).lower() and "\n" not in r["real_value_encrypted"]
    token = first["acme", "ABP Corporation"]
    asked = spark.createDataFrame([(token,), (token,), ("ACCOUNT_none",)], "token string")
    assert [tuple(r) for r in tokens.reveal(asked, store, "acme", KEY).collect()] == [(token, "ABP Corporation")]
    assert tokens.reveal(asked, store, "globex", KEY).count() == 0
    with pytest.raises(Exception, match="ambiguous"):
        tokens.reveal(asked, store.unionByName(store), "acme", KEY).collect()
    assert tokens.read_store(spark, f"{tmp_path}/none").count() == 0


def test_token_of_a_known_value(spark):
    row = values(spark, [("tenant", "account", "Acme Corp", 1)])
    got = tokens.tokenised(row).first()
    assert got["real_value_hash"] == got["real_value_hash"].upper() and got["token"] == "ACCOUNT_" + got["real_value_hash"][:12].lower()


def test_encryption(spark):
    df = spark.createDataFrame([("secret " * 40,), ("",), (None,)], "v string").withColumn("s", tokens.protect("v", KEY))
    df.write.mode("overwrite").format("noop").save()
    rows = df.select("v", "s", tokens.unprotect("s", KEY).alias("back")).collect()
    assert all(r["v"] == r["back"] for r in rows)
    same = spark.createDataFrame([("x",), ("x",)], "v string").select(tokens.protect("v", KEY).alias("s")).collect()
    assert same[0]["s"] != same[1]["s"]  # a nonce of its own each time
    with pytest.raises(ValueError):
        tokens.protect("v", b"short")
    with pytest.raises(Exception):
        spark.createDataFrame([("A" * 60,)], "s string").select(tokens.unprotect("s", KEY)).collect()


def test_stream_replay_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/in"
    values(spark, [("t", "Account", f"name {i % 5}", i) for i in range(20)]).drop("at").write.parquet(path)
    for k in range(2):
        stream = spark.readStream.schema("tenant_id string, token_type string, real string").parquet(path)
        register_stream(stream, f"{tmp_path}/store", KEY, f"{tmp_path}/check{k}").awaitTermination(60)
    assert tokens.read_store(spark, f"{tmp_path}/store").count() == 5


def test_null_tenants_and_types_register_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = values(spark, [(None, "Account", "one", 1), (None, None, "two", 2), ("t", "Account", "one", 3), ("", "account", "ONE", 4)])
    for _ in range(3):
        shown = tokens.register(rows, path, tokens.Aes(KEY), "at")
        assert shown.count() == 4 and shown.where("token is null").count() == 0
    store = tokens.read_store(spark, path)
    assert store.count() == 3 and tokens.read_store(spark, path, "").count() == 2 and tokens.read_store(spark, path, "t").count() == 1
    asked = store.select("token")
    assert {r["real"] for r in tokens.reveal(asked, store, "", KEY).collect()} == {"one", "two"}


def test_only_a_missing_store_is_empty(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        tokens.read_store(spark, "nosuch://host/store").count()


def test_numbers_of_kinds_of_any_size(spark):
    rows = [(i, ("a", "b", None, "c")[i % 4 if i % 50 == 0 else 0], f"n{i}") for i in range(400)]
    got = identities(spark, rows).collect()
    for kind in ("A", "B", "C", None):
        own = sorted((r["global_seq"], r["kind_seq"]) for r in got if r["kind"] == kind)
        assert [k for _, k in own] == list(range(1, len(own) + 1))


def within(spark, seconds, rows):
    """The rows, or an error where they take longer."""
    late = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        return rows().collect()
    finally:
        late.cancel()


def many(spark, n):
    names = spark.range(n).select(F.col("id").alias("ordinal"), F.lit("account").alias("kind"), F.format_string("Firm#%06d", "id").alias("name"))
    return pseudonyms.identity_map(names)


def test_hydrate_with_as_many_names_as_texts(spark):
    n = 40_000
    texts = spark.range(0, n, 1, 1).select("id", F.format_string("to ACCOUNT_%02d.", F.col("id") + 1).alias("t"))
    got = {r["id"]: r["h"] for r in within(spark, 60, lambda: pseudonyms.hydrate(texts, many(spark, n), "t", "h", longest_first=True).select("id", "h"))}
    assert got == {i: f"to Firm#{i:06d}." for i in range(n)}


def test_scrub_with_as_many_names_as_texts(spark):
    n = 40_000
    texts = spark.range(0, n, 1, 1).select("id", F.format_string("to FIRM#%06d.", "id").alias("t"))
    got = {r["id"]: r["s"] for r in within(spark, 60, lambda: pseudonyms.scrub(texts, many(spark, n), "t", "s").select("id", "s"))}
    assert got == {i: f"to ACCOUNT_{i + 1:02d}." for i in range(n)}


@pytest.mark.parametrize("fold", [False, True])
def test_replaced_as_by_a_loop_over_all_words(fold):
    draw, changed = random.Random(7), 0
    for k in range(4000):
        word = lambda lo, hi: "".join(draw.choices("abA_1" if k % 2 else "éÉ\U00010400\U00010428", k=draw.randint(lo, hi)))  # noqa: B023, E731
        pairs = [(word(1, 1 + k % 7), word(0, 4)) for _ in range(draw.randint(0, 8))]  # what is put makes new words, alone or with its surroundings
        text = want = word(0, 20)
        for old, new in pairs:
            want = re.sub(re.escape(old), lambda _: new, want, flags=re.IGNORECASE if fold else 0)  # noqa: B023
        assert pseudonyms.Replacements(pairs, fold)(text) == want
        changed += want != text
    assert changed > 1000


def test_case_as_in_patterns_of_java(spark):
    of = lambda method, c: f"java_method('java.lang.Character', '{method}', {c})"
    known = spark.range(0x110000).where("id not between 55296 and 57343").selectExpr("int(id) AS c").where(of("isDefined", "c") + " = 'true'")
    rows = known.selectExpr("c", f"int({of('toLowerCase', f'int({of("toUpperCase", "c")})')}) AS f").where("c < 131072 OR c != f").collect()
    assert len(rows) > 80_000 and all(pseudonyms.folded(chr(r["c"])) == chr(r["f"]) for r in rows)


def test_names_and_texts_with_odd_rows(spark):
    texts = spark.createDataFrame([("\u212aelvin \u0130NK, stra\u00dfe STRASSE",), (None,), ("",)], "t string")
    none = identities(spark, [(1, "account", " ")])
    assert [r["s"] for r in pseudonyms.hydrate(pseudonyms.scrub(texts, none, "t", "s"), none, "s", "s").collect()] == [r["t"] for r in texts.collect()]
    session = identities(spark, [(1, "account", "kelvin ink"), (2, "vendor", "STRA\u00dfE"), (3, "account", "Vendor_01")])
    assert pseudonyms.scrub(texts, session, "t", "s").first()["s"] == "ACCOUNT_01, VENDOR_01 STRASSE"
    unknown = identities(spark, [(1, None, "kelvin")])
    assert pseudonyms.scrub(texts, unknown, "t", "s").first()["s"] is None

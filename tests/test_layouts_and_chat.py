import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright import shared
from tidewright.operators import agents, chat, ocr, prompts
from tidewright.shared import numbered

WORDS = "array<struct<content:string,confidence:float,polygon:array<float>>>"


def masked(spark, text, words):
    df = spark.createDataFrame([(text, None if words is None else [(w, c, None) for w, c in words])], f"t string, w {WORDS}")
    return df.select(ocr.masked("t", F.col("w")).alias("m")).first()["m"]


@pytest.mark.parametrize(
    ("text", "words", "want"),
    [
        ("a b c", [("A", 0.9), ("b", 0.49), ("c", 0.5)], "a [?] c"),
        ("a b c d", [("a", 0.1), ("b", 0.1), ("c", 0.9), ("d", 0.1)], "[?] c [?]"),
        ("a b", [("a", 0.1), ("b", 0.1)], "[SIGNATURE/HANDWRITING]"),
        ("a  b ", None, "a  b "), ("a  b ", [], "a  b "), ("  ", [("a", 0.1)], "  "),
        ("b a", [("a", 0.1), ("b", 0.9)], "b a"), ("x a", [("a", 0.1)], "x [?]"), ("a a", [("a", 0.1), ("a", 0.9)], "[?] a"),
        ("[?] a", [("a", 0.1)], "[?]"),
    ],
)
def test_masking(spark, text, words, want):
    assert masked(spark, text, words) == want


def layout(spark, doc):
    return spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", ocr.LAYOUT).alias("d"))


def test_structured_text_and_pages(spark):
    cells = [{"row": 0, "col": 0, "content": "h|1"}, {"row": 0, "col": 0, "content": "second"}, {"row": 2, "col": 1, "content": "x"}]
    words = [{"content": "low", "confidence": 0.2}]
    page = lambda n, **k: {"page_number": n, "words": words, "lines": [{"content": "low line"}, {"content": " "}], **k}
    doc = {"pages": [page(1, width=3.0), page(2, unit="cm")], "paragraphs": [{"content": "low end", "bounding_regions": [{"page_number": 2, "polygon": [1.0]}, {"page_number": 9}]}, {"content": " "}, {"content": "low free"}], "tables": [{"cells": cells}]}
    row = layout(spark, doc).select(ocr.structured_text("d").alias("t"), ocr.page_data("d").alias("p")).first()
    table = "\n[TABLE]\n| h\\|1 |  |\n| --- | --- |\n|  |  |\n|  | x |\n[/TABLE]"
    assert row["t"] == "[?] end\n\nlow free\n\n" + table
    assert [(p["page_number"], p["width"], p["unit"], len(p["paragraphs"])) for p in row["p"]] == [(1, 3.0, "inch", 0), (2, 0.0, "cm", 1)]
    assert row["p"][1]["paragraphs"][0]["content"] == "low end" and row["p"][0]["lines"][0]["polygon"] == []
    lines = {**doc, "paragraphs": [], "tables": None}
    assert layout(spark, lines).select(ocr.structured_text("d").alias("t")).first()["t"] == "[?] line\n\n[?] line"
    assert layout(spark, {}).select(ocr.structured_text("d").alias("t"), ocr.page_data("d").alias("p")).first() == ("", [])
    with pytest.raises(Exception, match="no cells"):
        layout(spark, {"tables": [{"cells": []}]}).select(ocr.structured_text("d")).collect()


def one(spark, column, **given):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in given.items())
    return spark.createDataFrame([tuple(given.values())], schema).select(column.alias("x")).first()["x"]


def test_bodies(spark):
    c = F.col
    body = chat.openai_body(c("u"), c("s"), c("m"), c("t"), c("j"), c("k").cast("int"), "d")
    assert json.loads(one(spark, body, u="hi", s="sys", m=None, t=0.0, j=True, k=5)) == {
        "model": "d", "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "hi"}], "temperature": 0.0, "response_format": {"type": "json_object"}, "max_tokens": 5}
    assert json.loads(one(spark, body, u="hi", s="", m="own", t=0.5, j=False, k=None)) == {"model": "own", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.5}
    other = chat.anthropic_body(c("u"), c("s"), c("m"), c("t"), c("k").cast("int"), "d")
    assert json.loads(one(spark, other, u="hi", s=None, m=None, t=0.0, k=None)) == {"model": "d", "max_tokens": 1024, "messages": [{"role": "user", "content": "hi"}], "temperature": 0.0}
    assert json.loads(one(spark, other, u="hi", s="sys", m="x", t=0.0, k=9))["system"] == "sys"


def test_answers(spark):
    wrap = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    cases = {wrap("x"): "x", wrap([{"text": "a"}, {"n": 1}, {"text": 3}, {"text": "b"}]): "ab", wrap(None): "", wrap(5): "", '{"choices": []}': "", "{}": "", wrap([]): "", '{"choices": [{"message": {}}]}': ""}
    for raw, want in cases.items():
        assert one(spark, chat.openai_content("r"), r=raw) == want, raw
    with pytest.raises(Exception, match="no message"):
        one(spark, chat.openai_content("r"), r='{"choices": [{"x": 1}]}')
    blocks = {'{"content": [{"text": "a"}, {"type": "t"}, {"text": 1}, {"text": "b"}]}': "ab", '{"content": "a"}': "", "{}": "", '{"content": []}': ""}
    for raw, want in blocks.items():
        assert one(spark, chat.anthropic_content("r"), r=raw) == want, raw


def test_routing(spark):
    for key, want in ((None, "openai"), ("", "openai"), (" ", "openai"), ("ANTHROPIC", "anthropic"), ("openai", "openai"), ("other", "openai"), (" anthropic", "openai")):
        assert one(spark, chat.provider("k"), k=key) == want

    class Fixed:
        def __init__(self, text):
            self.text = text

        def complete(self, request):
            return self.text

    registry = agents.ProviderRegistry({"openai": Fixed("o"), "Anthropic": Fixed("a")}, "openai")
    assert [registry.complete({"provider_key": k}) for k in (None, "x", "ANTHROPIC")] == ["o", "o", "a"]
    turn = F.struct(F.lit("s").alias("system"), F.lit("u").alias("user"), F.lit(True).alias("json"), F.lit(0.2).alias("temperature"))
    assert spark.range(1).select(chat.request_of_turn(turn).alias("r")).first()["r"].asDict() == {
        "user_prompt": "u", "system_prompt": "s", "model": None, "temperature": 0.2, "json_response": True, "max_tokens": None, "provider_key": None}


class Number(agents.Agent):
    key, fallback_prompt, schema = "number", "fallback", T.IntegerType()

    def build_user(self, row):
        return row["t"]

    def parse(self, raw):
        return int(raw)

    def on_failure(self):
        return -1


def number_chat(turn):
    if turn["user"] == "fail":
        raise TimeoutError
    return "x" if turn["user"] == "bad" else str(len(turn["system"]))


def test_agent(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "fail")], "i int, t string")
    source = spark.createDataFrame([("number", "four"), ("other", "no")], "prompt_key string, text string")
    assert {r["i"]: r["result"] for r in Number().run(rows, number_chat).collect()} == {1: 8, 2: -1}
    assert {r["i"]: r["result"] for r in Number().run(rows, number_chat, source).collect()} == {1: 4, 2: -1}
    assert {r["i"]: r["result"] for r in Number().run(rows, number_chat, source.where("false")).collect()} == {1: 8, 2: -1}
    with pytest.raises(Exception, match="invalid literal"):
        Number().run(spark.createDataFrame([(1, "bad")], "i int, t string"), number_chat).collect()


class Echo(agents.BatchAgent):
    def build_user(self, items):
        return "|".join(i["t"] for i in items)

    def try_parse(self, raw, items):
        return None if raw == "?" else raw.split("|")

    def flagged(self, item):
        return "flagged " + item["t"]


class Flaky:
    def __init__(self):
        self.calls = {}

    def __call__(self, turn):
        n = self.calls[turn["user"]] = self.calls.get(turn["user"], 0) + 1
        if turn["user"].startswith("t12|") and n == 1:
            raise ConnectionError
        return "?" if turn["user"].startswith("t24") else turn["user"].upper()


def test_batches(spark):
    items = numbered(spark.createDataFrame([(f"t{i}", i) for i in range(25)], "t string, i int").repartition(3), [F.col("i")]).drop("i")
    got = [tuple(r) for r in Echo().run(items, Flaky(), "ordinal").orderBy("position").collect()]
    assert got == [(i, f"T{i}") for i in range(24)] + [(24, "flagged t24")]
    assert Echo().run(items.where("false"), Flaky(), "ordinal").count() == 0


def test_caches():
    now = [0.0]
    sliding = prompts.PromptCache(clock=lambda: now[0], seconds=10)
    sliding.put("a", None)
    now[0] = 9
    assert sliding.get("a") == (True, None)
    now[0] = 18
    assert sliding.get("a")[0]
    now[0] = 29
    assert not sliding.get("a")[0]
    calls = []

    def fetch(key):
        calls.append(key)
        if key == "down":
            raise OSError
        return {"has": (200, "text"), "none": (404, None), "null": (200, None), "err": (500, "x")}[key]

    source = prompts.RemotePrompts(fetch, prompts.PromptCache(sliding=False, clock=lambda: now[0], seconds=10))
    for _ in range(2):
        assert [source.get(k, "f") for k in ("has", "none", "null", "err", "down")] == ["text", "f", "f", "f", "f"]
    assert calls == ["has", "none", "null", "err", "down", "err", "down"]
    now[0] += 11
    source.get("has", "f")
    assert calls[-1] == "has"


def test_remote_table(spark):
    source = prompts.RemotePrompts(lambda k: (200, f"p {k}") if k == "a" else (404, None))
    got = {tuple(r) for r in source.table(spark, [("a", "f"), ("b", "f"), ("a", "f")]).collect()}
    assert got == {("a", "p a"), ("b", "f")}


def templates(spark, rows):
    plain = spark.createDataFrame(rows, "prompt_key string, client_id int, prompt_text string, model_id string, version int, is_active boolean, include_in_quality_analysis boolean")
    return spark.createDataFrame([], prompts.SCHEMA).unionByName(plain, allowMissingColumns=True)


def test_prompt_service(spark, tmp_path):
    now, told = [0.0], []

    class Hook:
        def superseded(self, events):
            told.extend(tuple(r) for r in events.collect())

    repository = prompts.SnapshotRepository(spark, f"{tmp_path}/prompts")
    assert repository.load().count() == 0
    repository.save(templates(spark, [("k", None, "global", "m", 1, True, True), ("k", 1, "own", None, 1, True, False), ("e", None, "", None, 1, True, False)]))
    service = prompts.PromptService(repository, prompts.PromptCache(clock=lambda: now[0], seconds=10), Hook())
    asked = [("k", None), ("k", 1), ("k", 2), ("e", None), ("none", None)]
    assert service.texts(asked) == {("k", None): "global", ("k", 1): "own", ("k", 2): "global", ("e", None): "", ("none", None): ""}
    assert service.models([("k", 1), ("e", None)]) == {("k", 1): "m", ("e", None): None}
    service.upsert(templates(spark, [("k", None, "new", "m2", 9, False, True), ("none", None, "now", None, 1, True, True)]))
    assert told == [("k", None, 1, 2)]
    assert service.texts(asked) == {("k", None): "new", ("k", 1): "own", ("k", 2): "global", ("e", None): "", ("none", None): "now"}  # client 2's stays until it expires
    assert service.models([("k", 1)]) == {("k", 1): "m"}
    now[0] = 11
    assert service.get("k", "f", 2) == "new" and service.get("e", "f") == "f" and service.models([("k", 1)]) == {("k", 1): "m2"}
    service.reset("k", 1)
    assert service.get("k", "f", 1) == "new"
    assert service.rollback("k", None, 1) and not service.rollback("k", None, 99)
    assert service.get("k", "f") == "global" and [r["version"] for r in service.history("k").collect()] == [3, 2, 1] and service.visible(1).count() == 3
    assert {tuple(r) for r in service.table(spark, [("k", None), ("x", None)]).collect()} == {("k", None, "global"), ("x", None, "")}


def test_agents_with_sources_and_clients(spark):
    rows = spark.createDataFrame([(1, "ok", "a"), (2, "ok", "b"), (3, "ok", None)], "i int, t string, c string")
    source = spark.createDataFrame([("number", None, "four"), ("number", "a", "threes"), ("number", "b", ""), ("other", "a", "x")], "prompt_key string, client_id string, text string")
    assert {r["i"]: r["result"] for r in Number().run(rows, number_chat, source, client="c").collect()} == {1: 6, 2: 8, 3: 4}
    remote = prompts.RemotePrompts(lambda key: (200, "seven77") if key == "number" else (404, None))
    assert {r["result"] for r in Number().run(rows, number_chat, remote).collect()} == {7}


def test_running_totals_carry_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, 1, 2, 3) for i in range(50)], "x int, _part int, Part int, `one` int").repartition(3)
    out = numbered(df, [F.col("x")], "n")
    assert out.columns == ["x", "_part", "Part", "one", "n"] and all(r["x"] == r["n"] and r[1:4] == (1, 2, 3) for r in out.collect())


def test_long_pages_are_masked_in_linear_time(spark):
    import time

    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    words = F.transform(F.split("t", " "), lambda w, i: F.struct(w.alias("content"), F.when(i % 7 == 0, 0.1).otherwise(0.9).cast("float").alias("confidence"), F.lit(None).cast("array<float>").alias("polygon")))
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(ocr.masked("t", words).alias("m")).first()["m"].split(" ")
    assert len(got) == 60_000 and got[7] == "[?]" and got[8] == "w8" and time.time() - began < 60


def test_tables_made_on_the_way_are_deleted(spark, tmp_path):
    df = spark.range(10).repartition(2)
    with shared.tidied(spark):
        inner = shared.written(df)
        numbered(inner, [F.col("id")], "n").write.parquet(f"{tmp_path}/kept")
        path = inner._tw_path
        assert spark.read.parquet(path).count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 10

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import agents, chat
from tidewright.sources import chats


def post(path, body):
    b = json.loads(body)
    said = b["messages"][-1]["content"]
    if said == "fail":
        return 500, "no"
    if path == "chat/completions":
        return 200, json.dumps({"choices": [{"message": {"content": [{"text": b["model"]}, {"text": said}]}}]})
    return 201, json.dumps({"content": [{"text": f"{b['max_tokens']} {b.get('system', '-')} "}, {"x": 1}, {"text": said}]})


def test_completed_rows(spark):
    rows = spark.createDataFrame([(1, "hi"), (2, "yo")], "i int, u string")
    none = F.lit(None).cast("string")
    openai = chat.openai_body(F.col("u"), none, none, F.lit(0.0), F.lit(False), F.lit(None).cast("int"), "m ")
    assert {tuple(r) for r in chats.completed(rows, openai, post).collect()} == {(1, "hi", "m hi"), (2, "yo", "m yo")}
    other = chat.anthropic_body(F.col("u"), F.lit("sys"), none, F.lit(0.0), F.lit(None).cast("int"), "m")
    assert {r["content"] for r in chats.completed(rows, other, post, chat.ANTHROPIC).collect()} == {"1024 sys hi", "1024 sys yo"}
    with pytest.raises(Exception, match="status 500"):
        chats.completed(rows.withColumn("u", F.lit("fail")), openai, post).collect()


def test_providers_and_routing():
    seen = []

    def spy(path, body):
        seen.append((path, json.loads(body)))
        return post(path, body)

    a, o = chats.AnthropicShape(spy, chat.AnthropicOptions(model_id="ma")), chats.OpenAiShape(spy, chat.LlmOptions(model_id="mo"))
    registry = agents.ProviderRegistry({"openai": o, "anthropic": a}, "openai")
    assert registry.complete({"user_prompt": "hi", "provider_key": "ANTHROPIC", "max_tokens": 5}) == "5 - hi"
    assert registry.complete({"user_prompt": "hi", "system_prompt": "s", "json_response": True, "model": "own"}) == "ownhi"
    assert seen[1][1] == {"model": "own", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}], "temperature": 0.0, "response_format": {"type": "json_object"}}
    assert "json" not in seen[0][1] and "system" not in seen[0][1]
    assert chats.agent_chat(registry)({"system": "", "user": "hi", "json": False, "temperature": 0.2}) == "mohi"
    with pytest.raises(chats.EndpointError):
        a.complete({"user_prompt": "fail"})


@pytest.mark.parametrize(("answer", "text"), [({}, ""), ({"choices": []}, ""), ({"choices": [{"message": {"content": None}}]}, ""), ({"choices": [{"message": {"content": "x"}}]}, "x")])
def test_odd_answers(answer, text):
    provider = chats.OpenAiShape(lambda p, b: (200, json.dumps(answer)), chat.LlmOptions())
    assert provider.complete({"user_prompt": "u"}) == text
    assert chats.AnthropicShape(lambda p, b: (200, '{"content": "x"}'), chat.AnthropicOptions()).complete({"user_prompt": "u"}) == ""

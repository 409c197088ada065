"""Model endpoints as sources: bodies out, texts in, over an injected ``post(path, body) -> (status, answer)``.

``completed`` runs a column of bodies; the provider classes serve agents, one request at a time. Both raise on an
answer that isn't 2xx.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame

from ..operators import chat
from ..operators.agents import Chat, ProviderRegistry

Post = Callable[[str, str], tuple[int, str]]
PATHS = {chat.OPENAI: "chat/completions", chat.ANTHROPIC: "v1/messages"}


class EndpointError(RuntimeError):
    """An endpoint answered with a status that isn't 2xx."""


def _ask(post: Post, path: str, body: str) -> str:
    status, answer = post(path, body)
    if not 200 <= status < 300:
        raise EndpointError(f"{path}: status {status}")
    return answer


def completed(rows: DataFrame, body: Column, post: Post, shape: str = chat.OPENAI, out: str = "content") -> DataFrame:
    """``rows`` with the text of the endpoint's answer to each row's body.

    Calls repeat if a task is retried, so write the result before using it twice.
    """
    path = PATHS[shape]
    asked = rows.withColumn("_body", body)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_body=[_ask(post, path, x) for x in b["_body"]])

    content = chat.openai_content("_body") if shape == chat.OPENAI else chat.anthropic_content("_body")
    return asked.mapInPandas(call, asked.schema).withColumn(out, content).drop("_body")


def _joined(parts: Any) -> str:
    return "".join(p["text"] for p in parts if isinstance(p, dict) and isinstance(p.get("text"), str))


class OpenAiShape:
    """Serves requests at an endpoint of the OpenAI shape."""

    def __init__(self, post: Post, options: chat.LlmOptions) -> None:
        self.post, self.options = post, options

    def complete(self, request: dict[str, Any]) -> str:
        system = [{"role": "system", "content": request["system_prompt"]}] if request.get("system_prompt") else []
        body: dict[str, Any] = {"model": self.options.model_id if request.get("model") is None else request["model"]}
        body |= {"messages": [*system, {"role": "user", "content": request["user_prompt"]}], "temperature": request.get("temperature", 0.0)}
        if request.get("json_response"):
            body["response_format"] = {"type": "json_object"}
        if request.get("max_tokens") is not None:
            body["max_tokens"] = request["max_tokens"]
        choices = json.loads(_ask(self.post, PATHS[chat.OPENAI], json.dumps(body))).get("choices")
        if not choices:
            return ""
        content = choices[0]["message"].get("content")
        return content if isinstance(content, str) else _joined(content) if isinstance(content, list) else ""


class AnthropicShape:
    """Serves requests at an endpoint of the Anthropic shape, which has no JSON mode."""

    def __init__(self, post: Post, options: chat.AnthropicOptions) -> None:
        self.post, self.options = post, options

    def complete(self, request: dict[str, Any]) -> str:
        body: dict[str, Any] = {"model": self.options.model_id if request.get("model") is None else request["model"]}
        body |= {"max_tokens": self.options.default_max_tokens if request.get("max_tokens") is None else request["max_tokens"]}
        body |= {"messages": [{"role": "user", "content": request["user_prompt"]}], "temperature": request.get("temperature", 0.0)}
        if request.get("system_prompt"):
            body["system"] = request["system_prompt"]
        content = json.loads(_ask(self.post, PATHS[chat.ANTHROPIC], json.dumps(body))).get("content")
        return _joined(content) if isinstance(content, list) else ""


def agent_chat(registry: ProviderRegistry) -> Chat:
    """An agent's chat function over a registry; turns carry no routing key, so they go to the default provider."""

    def ask(turn: dict[str, Any]) -> str:
        return registry.complete({"user_prompt": turn["user"], "system_prompt": turn["system"], "temperature": turn["temperature"], "json_response": turn["json"]})

    return ask

"""Typed model calls over rows, one by one or in chunks, with an injected chat function.

Everything but the call itself is declared: the prompt comes by a join, results have a schema. Calls repeat if a
task is retried, so materialise results before using them twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prompts import or_fallback

BATCH_SIZE, MAX_ATTEMPTS = 12, 2


class Chat(Protocol):
    """``chat(turn) -> raw text``; a turn has system, user, json and temperature. Must be picklable."""

    def __call__(self, turn: dict[str, Any]) -> str: ...


class ChatProvider(Protocol):
    """``complete(request) -> raw text`` for one provider."""

    def complete(self, request: dict[str, Any]) -> str: ...


class PromptSource(Protocol):
    def get(self, key: str, fallback: str) -> str: ...


class ProviderRegistry:
    """Providers by name; unknown, blank or missing names give the default."""

    def __init__(self, providers: dict[str, Any], default: str) -> None:
        self.providers = {k.lower(): v for k, v in providers.items()}
        self.default = self.providers[default.lower()]

    def resolve(self, key: str | None) -> Any:
        return self.providers.get((key or "").lower(), self.default)

    def complete(self, request: dict[str, Any]) -> str:
        return self.resolve(request.get("provider_key")).complete(request)


class Agent:
    """One call per row. Override the hooks; ``schema`` is the result's type."""

    key = ""
    fallback_prompt = ""
    schema: T.DataType = T.StringType()
    json = True
    temperature = 0.2

    def build_user(self, row: dict[str, Any]) -> str:
        raise NotImplementedError

    def parse(self, raw: str) -> Any:
        raise NotImplementedError

    def on_failure(self) -> Any:
        raise NotImplementedError

    def run_one(self, chat: Chat, system: str, row: dict[str, Any]) -> Any:
        turn = {"system": system, "user": self.build_user(row), "json": self.json, "temperature": self.temperature}
        try:
            raw = chat(turn)
        except Exception:
            return self.on_failure()
        return self.parse(raw)  # its errors are the caller's

    def run(self, rows: DataFrame, chat: Chat, prompts: DataFrame | PromptSource | None = None, out: str = "result", client: str | None = None) -> DataFrame:
        """``rows`` with a result column.

        ``prompts`` is a source asked once, or a table (``prompt_key``, ``text``); with ``client``, a column of ``rows``, the table's
        ``client_id`` tells the clients' texts and, where null, the one for all others.
        """
        system = F.lit(self.fallback_prompt)
        columns = rows.columns
        if isinstance(prompts, DataFrame):
            mine = prompts.where(F.col("prompt_key") == self.key)
            every = mine if client is None else mine.where("client_id is null")
            rows = rows.crossJoin(every.agg(F.max("text").alias("_system")))  # one row
            system = F.col("_system")
            if client is not None:
                own = mine.where("client_id is not null").groupBy(F.col("client_id").alias("_client")).agg(F.max("text").alias("_own"))
                rows, system = rows.join(own, F.col(client) == F.col("_client"), "left"), F.coalesce("_own", "_system")
            system = or_fallback(system, self.fallback_prompt)
        elif prompts is not None:
            system = F.lit(prompts.get(self.key, self.fallback_prompt))
        given = rows.select(*columns, system.alias("_system"))
        schema = T.StructType([*given.drop("_system").schema.fields, T.StructField(out, self.schema)])
        agent = self

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                records = b.drop(columns="_system").to_dict("records")
                b = b.rename(columns={"_system": out})
                b[out] = pd.Series([agent.run_one(chat, s, r) for s, r in zip(b[out], records, strict=True)], index=b.index, dtype=object)
                yield b

        return given.mapInPandas(call, schema)


class BatchAgent:
    """One call per chunk of consecutive rows, repeated if it fails or can't be parsed, then degraded row by row."""

    key = ""
    fallback_prompt = ""
    schema: T.DataType = T.StringType()
    batch_size = BATCH_SIZE
    max_attempts = MAX_ATTEMPTS
    temperature = 0.0

    def build_user(self, items: list[dict[str, Any]]) -> str:
        raise NotImplementedError

    def try_parse(self, raw: str, items: list[dict[str, Any]]) -> list[Any] | None:
        """Results of the chunk in order, or None if the answer is no good."""
        raise NotImplementedError

    def flagged(self, item: dict[str, Any]) -> Any:
        raise NotImplementedError

    def run_batch(self, chat: Chat, system: str, items: list[dict[str, Any]]) -> list[Any]:
        turn = {"system": system, "user": self.build_user(items), "json": True, "temperature": self.temperature}
        for _ in range(self.max_attempts):
            try:
                raw = chat(turn)
            except Exception:
                continue
            parsed = self.try_parse(raw, items)
            if parsed is not None:
                return parsed
        return [self.flagged(i) for i in items]

    def run(self, items: DataFrame, chat: Chat, ordinal: str, system: str | None = None, out: str = "result") -> DataFrame:
        """Rows of (``position``, result) in the order of ``items``.

        ``ordinal`` numbers the items without gaps from 0 (see ``shared.numbered``), so chunks are arithmetic and spread over tasks.
        The number of results of a chunk isn't checked against it; positions count within chunks.
        """
        chunk = F.floor(F.col(ordinal) / self.batch_size).cast("long")
        packed = items.groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("_at"), *[c for c in items.columns if c != ordinal]))).alias("items"))  # at most batch_size
        agent, prompt, size = self, self.fallback_prompt if system is None else system or self.fallback_prompt, self.batch_size
        schema = T.StructType([T.StructField("position", T.LongType()), T.StructField(out, self.schema)])

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                position, results = [], []
                for k, group in zip(b["chunk"], b["items"], strict=True):
                    rows = [{ordinal if n == "_at" else n: v for n, v in (r.asDict() if hasattr(r, "asDict") else dict(r)).items()} for r in group]
                    for i, r in enumerate(agent.run_batch(chat, prompt, rows)):
                        position.append(k * size + i)
                        results.append(r)
                yield pd.DataFrame({"position": position, out: pd.Series(results, dtype=object)})

        return packed.mapInPandas(call, schema)

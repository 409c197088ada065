"""Chat requests and answers as columns: request bodies, answer extraction, provider routing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import as_column

OPENAI, ANTHROPIC = "openai", "anthropic"
MAX_TOKENS = 1024


@dataclass(frozen=True)
class LlmOptions:
    """Endpoint of the OpenAI shape; closed over by functions, never a column."""

    base_url: str = ""
    api_key: str = field(default="", repr=False)
    model_id: str = ""


@dataclass(frozen=True)
class AnthropicOptions:
    """Endpoint of the Anthropic shape."""

    base_url: str = ""
    api_key: str = field(default="", repr=False)
    model_id: str = ""
    default_max_tokens: int = MAX_TOKENS


def _null_if(c: Column, when: Column) -> Column:
    return F.when(~when, c)


def openai_body(user: Column, system: Column, model: Column, temperature: Column, as_json: Column, max_tokens: Column, default_model: str) -> Column:
    """Request body of the OpenAI shape as JSON; absent parts are left out."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    both = F.array(message("system", system), message("user", user))
    messages = F.when(F.coalesce(system, F.lit("")) == "", F.array(message("user", user))).otherwise(both)
    return F.to_json(
        F.struct(
            F.coalesce(model, F.lit(default_model)).alias("model"), messages.alias("messages"), temperature.alias("temperature"),
            F.when(as_json, F.struct(F.lit("json_object").alias("type"))).alias("response_format"), max_tokens.alias("max_tokens"),
        )
    )


def anthropic_body(user: Column, system: Column, model: Column, temperature: Column, max_tokens: Column, default_model: str, default_max: int = MAX_TOKENS) -> Column:
    """Request body of the Anthropic shape as JSON; there is no JSON mode."""
    messages = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.to_json(
        F.struct(
            F.coalesce(model, F.lit(default_model)).alias("model"), F.coalesce(max_tokens, F.lit(default_max)).alias("max_tokens"), messages.alias("messages"),
            temperature.alias("temperature"), F.nullif(system, F.lit("")).alias("system"),
        )
    )


def _texts(parts: Column) -> Column:
    """Concatenated string ``text`` of an array of variants."""
    texts = F.transform(parts, lambda p: F.when(F.startswith(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")), F.lit("STRING")), F.try_variant_get(p, "$.text", "string")))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "")


def openai_content(answer: Column | str) -> Column:
    """Text of an OpenAI-shaped answer: a string, the joined parts of an array, else empty.

    A first choice without ``message`` raises.
    """
    doc = F.try_parse_json(as_column(answer))
    first = F.try_variant_get(doc, "$.choices[0]", "variant")
    content = F.try_variant_get(doc, "$.choices[0].message.content", "variant")
    kind = F.schema_of_variant(content)
    missing = F.try_variant_get(doc, "$.choices[0].message", "variant").isNull()
    return (
        F.when(first.isNull(), F.lit(""))
        .when(missing, F.raise_error(F.lit("the answer's first choice has no message")).cast("string"))
        .when(kind == "STRING", F.try_variant_get(content, "$", "string"))
        .when(F.startswith(kind, F.lit("ARRAY")), _texts(F.try_variant_get(content, "$", "array<variant>")))
        .otherwise(F.lit(""))
    )


def anthropic_content(answer: Column | str) -> Column:
    """Joined text of an Anthropic-shaped answer's blocks; empty if ``content`` isn't an array."""
    content = F.try_variant_get(F.try_parse_json(as_column(answer)), "$.content", "variant")
    return F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), _texts(F.try_variant_get(content, "$", "array<variant>"))).otherwise(F.lit(""))


def provider(key: Column | str, known: tuple[str, ...] = (OPENAI, ANTHROPIC), default: str = OPENAI) -> Column:
    """The provider of a routing key, ignoring case; null, blank and unknown keys give the default."""
    table = F.create_map(*[F.lit(x) for k in known for x in (k.lower(), k)])
    return F.coalesce(F.try_element_at(table, F.lower(as_column(key))), F.lit(default))


def request_of_turn(turn: Column | str) -> Column:
    """A turn (``system``, ``user``, ``json``, ``temperature``) as a request: model, limit and routing key stay null."""
    t = as_column(turn)
    return F.struct(
        t["user"].alias("user_prompt"), t["system"].alias("system_prompt"), F.lit(None).cast("string").alias("model"), t["temperature"].alias("temperature"),
        t["json"].alias("json_response"), F.lit(None).cast("int").alias("max_tokens"), F.lit(None).cast("string").alias("provider_key"),
    )

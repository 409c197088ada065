"""Versioned prompt templates with client overrides and global defaults.

Templates are a DataFrame (``SCHEMA``); a null client is the global default. Mutations return a new snapshot;
nothing is changed in place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "prompt_template_id long, prompt_key string, client_id int, prompt_text string, model_id string, description string, is_active boolean, version int, "
    "change_summary string, include_in_quality_analysis boolean, include_in_optimizer boolean, created_at timestamp, updated_at timestamp"
)
EGRESS = "promptKey string, promptText string, modelId string"
CACHE_SECONDS = 300


class PromptRepository(Protocol):
    """Where templates are kept."""

    def load(self) -> DataFrame: ...
    def save(self, templates: DataFrame) -> None: ...


class PromptSavedHook(Protocol):
    """Told about superseded versions: rows of key, client, previous and new version."""

    def superseded(self, events: DataFrame) -> None: ...


def active(templates: DataFrame) -> DataFrame:
    """The highest active version of each (key, client)."""
    best = F.max_by(F.struct(*[c for c in templates.columns if c not in ("prompt_key", "client_id")]), "version")
    grouped = templates.where("is_active").groupBy("prompt_key", "client_id").agg(best.alias("t"))
    return grouped.select(*[F.col(c) if c in ("prompt_key", "client_id") else F.col(f"t.{c}").alias(c) for c in templates.columns])


def resolve(requests: DataFrame, templates: DataFrame, missing_text: str | None = "") -> DataFrame:
    """``requests`` (``prompt_key``, ``client_id``) with ``text`` and ``model``: the client's, else the global one.

    Text and model fall back on their own; a missing text is ``missing_text``, a missing model null. An empty text
    is an override like any other.
    """
    now = active(templates)
    own = now.where("client_id is not null").select("prompt_key", "client_id", F.col("prompt_text").alias("_t1"), F.col("model_id").alias("_m1"))
    common = now.where("client_id is null").select("prompt_key", F.col("prompt_text").alias("_t0"), F.col("model_id").alias("_m0"))
    joined = requests.join(own, ["prompt_key", "client_id"], "left").join(common, "prompt_key", "left")
    text, model = F.coalesce("_t1", "_t0", F.lit(missing_text).cast("string")), F.coalesce("_m1", "_m0")
    return joined.select(*requests.columns, text.alias("text"), model.alias("model"))


def or_fallback(text: Column | str, fallback: Column | str | None) -> Column:
    """An empty or missing prompt becomes the caller's fallback."""
    given = F.lit(fallback) if isinstance(fallback, str) or fallback is None else fallback
    return F.coalesce(F.nullif(F.col(text) if isinstance(text, str) else text, F.lit("")), given)


def default_prompt(fallback: str) -> Column:
    """The source without overrides: always the caller's fallback."""
    return F.lit(fallback)


def visible(templates: DataFrame, client: int | None = None) -> DataFrame:
    """Active versions of the global prompts and the client's; an override doesn't hide the global row."""
    mine = F.col("client_id").isNull() if client is None else F.col("client_id").isNull() | (F.col("client_id") == client)
    return active(templates.where(mine))


def _same(key: str, client: int | None) -> Column:
    return (F.col("prompt_key") == key) & F.col("client_id").eqNullSafe(F.lit(client).cast("int"))


def history(templates: DataFrame, key: str, client: int | None = None) -> DataFrame:
    """All versions of one prompt, newest first."""
    return templates.where(_same(key, client)).orderBy(F.desc("version"))


def versions(templates: DataFrame) -> DataFrame:
    """Every version with the one before it."""
    w = Window.partitionBy("prompt_key", "client_id").orderBy("version")
    return templates.withColumn("previous_version", F.lag("version").over(w))


def upsert(templates: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot in which each change (at most one per key and client) is the next, only active version."""
    key = [F.col("prompt_key").alias("_k"), F.col("client_id").alias("_c")]
    top = templates.groupBy(*key).agg(F.max("version").alias("_top"))
    marked = changes.select(*key, F.lit(True).alias("_hit"))
    same = (F.col("prompt_key") == F.col("_k")) & F.col("client_id").eqNullSafe(F.col("_c"))
    archived = {"is_active": F.col("is_active") & F.col("_hit").isNull()}
    latest = {"is_active": F.lit(True), "version": (F.coalesce("_top", F.lit(0)) + 1).cast("int")}
    old = templates.join(marked, same, "left").select(*[archived.get(c, F.col(c)).alias(c) for c in templates.columns])
    new = changes.join(top, same, "left").select(*[latest.get(c, F.col(c)).alias(c) for c in templates.columns])
    return old.unionByName(new)


def reset(templates: DataFrame, key: str, client: int) -> DataFrame:
    """Deactivate a client's versions, which stay as history."""
    return templates.withColumn("is_active", F.col("is_active") & ~_same(key, client))


def rollback(templates: DataFrame, key: str, client: int | None, version: int) -> DataFrame:
    """Copy a former version as the new active one; the snapshot is unchanged if there is no such version."""
    chosen = templates.where(_same(key, client) & (F.col("version") == version)).withColumn("change_summary", F.lit(f"Rollback to version {version}"))
    return upsert(templates, chosen)


def superseded(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a save hook is told: (key, client, previous, new) for new active versions under quality analysis."""
    keys = ["prompt_key", "client_id"]
    old = before.where("is_active").groupBy(*keys).agg(F.max("version").alias("previous_version"))
    new = after.where("is_active and include_in_quality_analysis").groupBy(*keys).agg(F.max("version").alias("new_version"))
    joined = new.alias("n").join(old.alias("o"), (F.col("n.prompt_key") == F.col("o.prompt_key")) & F.col("n.client_id").eqNullSafe(F.col("o.client_id")))
    return joined.where("new_version > previous_version").select("n.prompt_key", "n.client_id", "previous_version", "new_version")


def egress_record(body: Column | str) -> Column:
    """Fields of a remote prompt answer."""
    return F.from_json(F.col(body) if isinstance(body, str) else body, EGRESS)


class PromptCache:
    """A driver-side cache of prompt lookups with sliding or absolute expiry.

    ``drop`` forgets one (key, client) only: clients that fell back to a global prompt keep what they have
    until it expires.
    """

    def __init__(self, sliding: bool = True, seconds: float = CACHE_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.sliding, self.seconds, self.clock = sliding, seconds, clock
        self._held: dict[object, tuple[float, object]] = {}

    def get(self, key: object) -> tuple[bool, object]:
        until, value = self._held.get(key, (float("-inf"), None))
        if self.clock() >= until:
            self._held.pop(key, None)
            return False, None
        if self.sliding:
            self.put(key, value)
        return True, value

    def put(self, key: object, value: object) -> None:
        self._held[key] = (self.clock() + self.seconds, value)

    def drop(self, *keys: object) -> None:
        for key in keys:
            self._held.pop(key, None)


class SnapshotRepository:
    """Templates as numbered Parquet snapshots below a folder; the one with the highest number is current."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def load(self) -> DataFrame:
        have = self._numbers()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{have[-1]}") if have else self.spark.createDataFrame([], SCHEMA)

    def save(self, templates: DataFrame) -> None:
        """A snapshot beside the one that ``templates`` may derive from; two writers at a time make one of them fail."""
        templates.write.parquet(f"{self.path}/v{max(self._numbers(), default=0) + 1}")


class PromptService:
    """Prompts of a repository through a cache; every change is saved, forgotten by the cache and told to the hook.

    Texts and models are remembered per (key, client), missing texts aren't. A change drops its own (key, client) only, so clients
    that fell back to a changed global prompt see it when theirs expires.
    """

    def __init__(self, repository: PromptRepository, cache: PromptCache | None = None, hook: PromptSavedHook | None = None) -> None:
        self.repository, self.cache, self.hook = repository, cache or PromptCache(), hook

    def texts(self, wanted: Iterable[tuple[str, int | None]]) -> dict[tuple[str, int | None], str]:
        return {k: v or "" for k, v in self._look_up("text", wanted).items()}

    def models(self, wanted: Iterable[tuple[str, int | None]]) -> dict[tuple[str, int | None], str | None]:
        return self._look_up("model", wanted)

    def _look_up(self, what: str, wanted: Iterable[tuple[str, int | None]]) -> dict[tuple[str, int | None], str | None]:
        found, missing = {}, []
        for pair in dict.fromkeys(wanted):
            hit, value = self.cache.get((what, *pair))
            if hit:
                found[pair] = value
            else:
                missing.append(pair)
        if missing:  # one query for all that isn't remembered
            templates = self.repository.load()
            asked = templates.sparkSession.createDataFrame(missing, "prompt_key string, client_id int")
            for r in resolve(asked, templates, missing_text=None).collect():
                pair = r["prompt_key"], r["client_id"]
                found[pair] = r[what]
                if what == "model" or r[what] is not None:
                    self.cache.put((what, *pair), r[what])
        return found

    def get(self, key: str, fallback: str, client: int | None = None) -> str:
        return self.texts([(key, client)])[key, client] or fallback

    def table(self, spark: SparkSession, wanted: Iterable[tuple[str, int | None]]) -> DataFrame:
        """The pairs' texts as rows, to be joined."""
        return spark.createDataFrame([(*k, v) for k, v in self.texts(wanted).items()], "prompt_key string, client_id int, text string")

    def visible(self, client: int | None = None) -> DataFrame:
        return visible(self.repository.load(), client)

    def history(self, key: str, client: int | None = None) -> DataFrame:
        return history(self.repository.load(), key, client)

    def upsert(self, changes: DataFrame) -> None:
        """Save the changes (at most one per key and client) and tell the hook which versions they superseded."""
        before = self.repository.load()
        self.repository.save(upsert(before, changes))
        self._forget([tuple(r) for r in changes.select("prompt_key", "client_id").distinct().collect()])  # what was changed by hand
        if self.hook is not None:
            changed = changes.select(F.col("prompt_key").alias("_k"), F.col("client_id").alias("_c"))
            events = superseded(before, self.repository.load())
            self.hook.superseded(events.join(changed, (F.col("prompt_key") == F.col("_k")) & F.col("client_id").eqNullSafe(F.col("_c")), "left_semi"))

    def reset(self, key: str, client: int) -> None:
        self.repository.save(reset(self.repository.load(), key, client))
        self._forget([(key, client)])

    def rollback(self, key: str, client: int | None, version: int) -> bool:
        """Whether there is such a version."""
        before = self.repository.load()
        if not before.where(_same(key, client) & (F.col("version") == version)).limit(1).count():
            return False
        self.repository.save(rollback(before, key, client, version))
        self._forget([(key, client)])
        return True

    def _forget(self, pairs: list[tuple[str, int | None]]) -> None:
        self.cache.drop(*[(what, *pair) for pair in pairs for what in ("text", "model")])


class RemotePrompts:
    """Prompts fetched by an injected ``fetch(key) -> (status, text or None)``.

    A found text and a 404 are remembered (the latter as "no override"); any other answer or an error gives the
    fallback and isn't.
    """

    def __init__(self, fetch: Callable[[str], tuple[int, str | None]], cache: PromptCache | None = None) -> None:
        self.fetch, self.cache = fetch, cache or PromptCache(sliding=False)

    def get(self, key: str, fallback: str) -> str:
        hit, text = self.cache.get(key)
        if hit:
            return text or fallback
        try:
            status, text = self.fetch(key)
        except Exception:
            return fallback
        if status == 404:
            text = ""
        elif not 200 <= status < 300:
            return fallback
        self.cache.put(key, text or "")
        return text or fallback

    def table(self, spark: SparkSession, wanted: Iterable[tuple[str, str]]) -> DataFrame:
        """The distinct (key, fallback) pairs resolved on the driver, to be joined to rows."""
        return spark.createDataFrame([(k, self.get(k, f)) for k, f in sorted(set(wanted))], "prompt_key string, text string")

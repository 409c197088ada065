"""Deterministic tenant-scoped tokens, with real values only encrypted in a key store.

The store is a Parquet table ``(tenant_id, token_type, token, real_value_hash, real_value_encrypted)``
partitioned by tenant; (tenant, hash) is unique because registration appends what an anti join leaves. A null
tenant or type counts as the empty one.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import as_column, is_blank, strip_newlines, trim_ws

STORE_SCHEMA = "tenant_id string, token_type string, token string, real_value_hash string, real_value_encrypted string"
NONCE, TAG = 12, 16
#: up to so many tenants of a batch the store is read in their partitions only
PRUNED = 1000


def tenant_hash(tenant: Column | str, kind: Column | str, real: Column | str) -> Column:
    sep = F.lit("\x01")
    return F.upper(F.sha2(F.concat(_named(tenant), sep, F.lower(_named(kind)), sep, F.lower(trim_ws(real))), 256))


def _named(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def token_for(kind: Column | str, hashed: Column | str) -> Column:
    return F.concat(F.upper(_named(kind)), F.lit("_"), F.lower(F.substring(as_column(hashed), 1, 12)))


class Cipher(Protocol):
    """Protects values before they are stored."""

    def protect(self, value: Column) -> Column: ...
    def unprotect(self, value: Column) -> Column: ...


class Aes:
    """The cipher of a 32-byte key."""

    def __init__(self, key: bytes) -> None:
        self.key = check_key(key)

    def protect(self, value: Column) -> Column:
        return protect(value, self.key)

    def unprotect(self, value: Column) -> Column:
        return unprotect(value, self.key)


def _cipher(given: bytes | Cipher) -> Cipher:
    return Aes(given) if isinstance(given, bytes) else given


def check_key(key: bytes) -> bytes:
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return key


def protect(value: Column | str, key: bytes) -> Column:
    """AES-256-GCM with a fresh nonce, as base64 of nonce, tag and ciphertext."""
    sealed = F.aes_encrypt(as_column(value).cast("binary"), F.lit(check_key(key)), F.lit("GCM"))
    # bound once: a second evaluation would draw another nonce
    def reorder(e: Column) -> Column:
        n = F.octet_length(e)
        return strip_newlines(F.base64(F.concat(F.substring(e, 1, NONCE), F.substring(e, n - TAG + 1, F.lit(TAG)), F.substring(e, NONCE + 1, n - NONCE - TAG))))

    return F.get(F.transform(F.array(sealed), reorder), F.lit(0))


def unprotect(value: Column | str, key: bytes) -> Column:
    """The inverse; a value that was tampered with raises."""
    raw = F.unbase64(as_column(value))
    n = F.octet_length(raw)
    sealed = F.concat(F.substring(raw, 1, NONCE), F.substring(raw, NONCE + TAG + 1, n), F.substring(raw, NONCE + 1, TAG))
    return F.aes_decrypt(sealed, F.lit(check_key(key)), F.lit("GCM")).cast("string")


def tokenised(values: DataFrame, tenant: str = "tenant_id", kind: str = "token_type", real: str = "real") -> DataFrame:
    """``values`` without blank ones, with ``real_value_hash`` and ``token``."""
    hashed = values.where(~is_blank(real)).withColumn("real_value_hash", tenant_hash(tenant, kind, real))
    return hashed.withColumn("token", token_for(kind, "real_value_hash"))


def new_entries(tokens: DataFrame, store: DataFrame, ordinal: str, tenant: str = "tenant_id", kind: str = "token_type", real: str = "real") -> DataFrame:
    """First value of each (tenant, hash) that the store doesn't have yet."""
    first = tokens.groupBy(_named(tenant).alias("tenant_id"), "real_value_hash").agg(F.min_by(F.struct(_named(kind).alias("k"), "token", trim_ws(real).alias("r")), ordinal).alias("v"))
    first = first.select("tenant_id", F.col("v.k").alias("token_type"), F.col("v.token").alias("token"), "real_value_hash", F.col("v.r").alias("real"))
    return first.join(store.select(_named("tenant_id").alias("tenant_id"), "real_value_hash"), ["tenant_id", "real_value_hash"], "left_anti")


def read_store(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    """The key store, or one tenant's partition of it; a store not written yet is empty, any other failure raises."""
    return _partitions(spark, path, None if tenant is None else [tenant])


def _partitions(spark: SparkSession, path: str, tenants: list[str] | None) -> DataFrame:
    """The store, read only where the partitions of ``tenants`` are; the empty tenant's is that of null."""
    try:
        store = spark.read.schema(STORE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        store = spark.createDataFrame([], STORE_SCHEMA)
    if tenants is not None:
        named = F.col("tenant_id").isin(*[t for t in tenants if t])
        store = store.where(named | F.col("tenant_id").isNull() if "" in tenants else named)
    return store.withColumn("tenant_id", _named("tenant_id"))


def register(values: DataFrame, path: str, key: bytes | Cipher, ordinal: str) -> DataFrame:
    """Tokens of all values, after appending new ones to the store at ``path``.

    The result is keyed by the exact input; of one input under two types the last type's token is shown.
    """
    tokens = tokenised(values)
    met = [r[0] for r in tokens.select(_named("tenant_id")).distinct().limit(PRUNED + 1).collect()]
    fresh = new_entries(tokens, _partitions(values.sparkSession, path, met if len(met) <= PRUNED else None), ordinal)
    rows = fresh.select("token_type", "token", "real_value_hash", _cipher(key).protect(F.col("real")).alias("real_value_encrypted"), "tenant_id")
    rows.write.mode("append").partitionBy("tenant_id").parquet(path)
    return shown(tokens, ordinal)


def shown(tokens: DataFrame, ordinal: str) -> DataFrame:
    return tokens.groupBy(_named("tenant_id").alias("tenant_id"), "real").agg(F.max_by("token", ordinal).alias("token"))


def reveal(tokens: DataFrame, store: DataFrame, tenant: str, key: bytes | Cipher) -> DataFrame:
    """Real values of a tenant's tokens; unknown tokens are left out, an ambiguous one raises."""
    own = store.where(F.col("tenant_id") == tenant).select("token", "real_value_encrypted")
    found = tokens.select("token").distinct().join(own, "token")
    once = found.groupBy("token").agg(F.count("*").alias("n"), F.first("real_value_encrypted").alias("sealed"))
    sealed = F.when(F.col("n") == 1, F.col("sealed")).otherwise(F.raise_error(F.concat(F.lit("ambiguous token "), F.col("token"))).cast("string"))
    return once.select("token", _cipher(key).unprotect(sealed).alias("real"))

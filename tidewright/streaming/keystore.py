"""Registration of streamed values: each micro-batch is merged into the key store.

Tokens derive from their content and the append follows an anti join, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokens import register


def register_stream(values: DataFrame, path: str, key: bytes, checkpoint: str) -> StreamingQuery:
    """Start registering ``values`` (``tenant_id``, ``token_type``, ``real``) into the store at ``path``."""

    def merge(batch: DataFrame, _number: int) -> None:
        register(batch.withColumn("_at", F.monotonically_increasing_id()), path, key, "_at")

    return values.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

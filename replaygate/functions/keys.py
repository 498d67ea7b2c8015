"""Deterministic event identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEDUP_KEY_COLS = ("source_topic", "client_id", "event_type", "entity_id")


def dedup_key(*cols) -> Column:
    """sha256 hex of the ':'-joined identity columns.

    Time and payload are not part of the identity. NULL parts are skipped and
    ':' inside values is not escaped, so ('a:b','c') and ('a','b:c') collide,
    as in the behaviour being reproduced.
    """
    cols = cols or DEDUP_KEY_COLS
    return F.sha2(F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in cols]), 256)


def with_dedup_key(df, cols=DEDUP_KEY_COLS, name: str = "dedup_key"):
    return df.withColumn(name, dedup_key(*cols))

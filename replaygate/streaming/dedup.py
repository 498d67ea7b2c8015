"""Streaming dedup and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import DEFAULT_POLICY


def with_event_watermark(df: DataFrame, delay: str = DEFAULT_POLICY.watermark, time_col: str = "event_ts") -> DataFrame:
    """Event-time watermark. Rows older than (max event time seen in earlier
    batches - delay) are dropped by the stateful operators downstream (T4);
    rows with a NULL event time are never late."""
    return df.withWatermark(time_col, delay)


def dedup_stream(df: DataFrame, delay: str = DEFAULT_POLICY.watermark, key: str = "dedup_key",
                 time_col: str = "event_ts") -> DataFrame:
    """Keep the first arrival of each key for ever.

    The watermark column is not part of the key, so state is never evicted:
    replays are caught however late they come, and state grows with the number
    of distinct keys (use the RocksDB state store)."""
    return with_event_watermark(df, delay, time_col).dropDuplicates([key])


def dedup_stream_bounded(df: DataFrame, delay: str = DEFAULT_POLICY.watermark, key: str = "dedup_key",
                         time_col: str = "event_ts") -> DataFrame:
    """Dedup within the watermark horizon; a key re-sent after the horizon
    counts as new and its state is evicted (bounded state)."""
    return with_event_watermark(df, delay, time_col).dropDuplicatesWithinWatermark([key])

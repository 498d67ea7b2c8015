"""Row filters (F1-F6). All are plain predicates, pushed into the scan where the
column is stored (e.g. batch_time for F1, topic for F2/F3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SUBSCRIBE_PATTERN
from .admission import split_admitted  # noqa: F401  (F6)
from .limits import throttled  # noqa: F401  (F5)
from .metrics import TOPIC, is_topic, recent  # noqa: F401  (F1)


def for_topic(df: DataFrame, topic: str, col: str = TOPIC) -> DataFrame:
    """one topic, or everything for 'all'; a missing topic reads as raw_events."""
    return df if topic == "all" else df.filter(is_topic(topic, col))


def for_topics(df: DataFrame, topics, col: str = TOPIC) -> DataFrame:
    """topic in a list."""
    return df.filter(F.col(col).isin(*list(topics)))


def match_topics(df: DataFrame, pattern: str = SUBSCRIBE_PATTERN, col: str = "topic") -> DataFrame:
    """topics whose whole name matches the subscription pattern."""
    return df.filter(F.col(col).rlike(f"^(?:{pattern})$"))

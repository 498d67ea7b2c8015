"""Duplicate metrics: per batch, rolled up over a window, exact over a span.

All aggregations are two-level (partial aggregation before the shuffle), so a
client or key holding a large share of the rows is combined map-side instead
of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import dup_ratio, idiv
from ..schema import DEFAULT_POLICY, RAW_TOPIC

TOPIC = "use_case_topic"
COUNT_COLS = ("raw_events", "unique_events", "duplicate_events")


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("duplicate_events", F.col("raw_events") - F.col("unique_events"))
              .withColumn("duplicate_ratio", dup_ratio("duplicate_events", "raw_events")))


def exact_metrics(df: DataFrame, topic_col: str = "source_topic", client_col: str = "client_id",
                  key_col: str = "dedup_key") -> DataFrame:
    """A3: raw, unique, duplicate counts and ratio per (topic, client) over the whole input.

    Written as count per key, then count of keys: both levels combine map-side,
    so neither a hot key nor a hot client is collected into one task, and no
    Expand is needed (unlike several distinct aggregates in one Aggregate).
    """
    per_key = df.groupBy(F.col(topic_col).alias(TOPIC), F.col(client_col).alias("client_id"),
                         F.col(key_col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    agg = per_key.groupBy(TOPIC, "client_id").agg(
        F.sum("_n").alias("raw_events"),
        F.count("_k").alias("unique_events"),
    )
    return _finish(agg)


def exact_metrics_from_counts(per_key: DataFrame, count_col: str = "_n", topic_col: str = "source_topic",
                              client_col: str = "client_id") -> DataFrame:
    """A3 from a table already counted per (topic, client, key): raw = sum of
    counts, unique = number of keys (rows with a positive count)."""
    agg = per_key.groupBy(F.col(topic_col).alias(TOPIC), F.col(client_col).alias("client_id")).agg(
        F.sum(count_col).cast("long").alias("raw_events"),
        F.count(F.lit(1)).alias("unique_events"),
    )
    return _finish(agg)


def batch_metrics(df: DataFrame, batch_col: str = "batch_id", topic_col: str = "source_topic",
                  client_col: str = "client_id", key_col: str = "dedup_key",
                  time_col: str | None = "event_ts") -> DataFrame:
    """A1: per micro-batch metrics by (topic, client); unique = distinct keys within the batch.

    ``batch_time`` is the batch's latest event time (the stand-in for the wall
    clock at which a live batch is written); without ``time_col`` it is NULL.
    """
    aggs = [F.count(F.lit(1)).alias("raw_events"), F.count_distinct(F.col(key_col)).alias("unique_events")]
    if time_col is not None:
        aggs.append(F.max(time_col).alias("_tmax"))
    per_group = df.groupBy(F.col(batch_col).alias("batch_id"), F.col(topic_col).alias(TOPIC),
                           F.col(client_col).alias("client_id")).agg(*aggs)
    out = _finish(per_group)
    if time_col is None:
        return out.withColumn("batch_time", F.lit(None).cast("timestamp"))
    # one scan: the batch time is the max over the batch's metric rows (a window
    # over aggregated rows, at most one per (topic, client) in the batch)
    from pyspark.sql import Window
    return out.withColumn("batch_time", F.max("_tmax").over(Window.partitionBy("batch_id"))).drop("_tmax")


#: Buckets of a distinct sketch are 2 to this power; its standard error is about 0.83 / 2^(this / 2).
SKETCH_BITS = 14


def sketched_metrics(df: DataFrame, batch_col: str = "batch_id", topic_col: str = "source_topic", client_col: str = "client_id",
                     key_col: str = "dedup_key", bits: int = SKETCH_BITS) -> DataFrame:
    """A3's sketch form: per micro-batch raw counts and a mergeable sketch of the keys
    by (topic, client). Stored with each batch's metrics, sketches add up across
    batches, which distinct counts do not."""
    return df.groupBy(F.col(batch_col).alias("batch_id"), F.col(topic_col).alias(TOPIC), F.col(client_col).alias("client_id")).agg(
        F.count(F.lit(1)).alias("raw_events"), F.hll_sketch_agg(F.col(key_col), F.lit(bits)).alias("keys"))


def merged_metrics(sketched: DataFrame, by=(TOPIC, "client_id")) -> DataFrame:
    """A2 over sketches: raw events and estimated unique keys of any set of batches;
    the estimate never exceeds the raw count."""
    out = sketched.groupBy(*by).agg(F.sum("raw_events").cast("long").alias("raw_events"), F.hll_union_agg("keys").alias("keys"))
    unique = F.least(F.hll_sketch_estimate("keys"), F.col("raw_events"))
    return _finish(out.withColumn("unique_events", unique.cast("long")).drop("keys"))


def recent(metrics: DataFrame, as_of=None, minutes: int = DEFAULT_POLICY.window_minutes,
           time_col: str = "batch_time") -> DataFrame:
    """rows with batch_time >= as_of - minutes (bound inclusive).

    ``as_of`` may be a literal timestamp/string or None, meaning the latest
    batch_time in the table (a scalar subquery, evaluated once)."""
    if as_of is None:
        as_of_col = metrics.select(F.max(time_col)).scalar()
    elif isinstance(as_of, Column):
        as_of_col = as_of
    else:
        as_of_col = F.lit(as_of).cast("timestamp")
    return metrics.filter(F.col(time_col) >= as_of_col - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def client_metrics(metrics: DataFrame, as_of=None, minutes: int | None = DEFAULT_POLICY.window_minutes,
                   ordered: bool = True) -> DataFrame:
    """A2: sums of batch metrics per (topic, client) over the window; ratio from the sums."""
    m = metrics if minutes is None else recent(metrics, as_of, minutes)
    out = m.groupBy(TOPIC, "client_id").agg(
        F.sum("raw_events").alias("raw_events"),
        F.sum("unique_events").alias("unique_events"),
        F.sum("duplicate_events").alias("duplicate_events"),
    ).withColumn("duplicate_ratio", dup_ratio("duplicate_events", "raw_events"))
    return out.orderBy(TOPIC, "client_id") if ordered else out


def topic_of(col: str = TOPIC) -> Column:
    """F2 helper: a missing topic reads as the raw topic."""
    return F.coalesce(F.col(col), F.lit(RAW_TOPIC))


def is_topic(topic: str, col: str = TOPIC) -> Column:
    """Whether a row's topic is ``topic``: plain equality, which scans push down;
    only for raw_events a missing topic counts too."""
    same = F.col(col) == F.lit(topic)
    return same | F.col(col).isNull() if topic == RAW_TOPIC else same


def topic_totals(metrics: DataFrame) -> DataFrame:
    """A4: messages, clean events, waste and ratio per topic."""
    out = metrics.groupBy(topic_of().alias(TOPIC)).agg(
        F.sum("raw_events").alias("raw_events"),
        F.sum("unique_events").alias("unique_events"),
        F.sum("duplicate_events").alias("duplicate_events"),
    )
    return out.withColumn("duplicate_ratio", dup_ratio("duplicate_events", "raw_events"))


def summary(metrics: DataFrame, topic: str = "all") -> DataFrame:
    """A5: grand totals and active clients (a missing client id counts as one client)."""
    m = metrics if topic == "all" else metrics.filter(is_topic(topic))
    out = m.agg(
        F.coalesce(F.sum("raw_events"), F.lit(0)).cast("long").alias("raw_events"),
        F.coalesce(F.sum("unique_events"), F.lit(0)).cast("long").alias("unique_events"),
        F.coalesce(F.sum("duplicate_events"), F.lit(0)).cast("long").alias("duplicate_events"),
        (F.count_distinct("client_id")
         + F.coalesce(F.max(F.col("client_id").isNull().cast("int")), F.lit(0))).cast("long").alias("clients"),
    )
    return out.withColumn("duplicate_ratio", dup_ratio("duplicate_events", "raw_events"))


def metrics_rollup(metrics: DataFrame) -> DataFrame:
    """Per (topic, client), per topic and grand totals in one pass."""
    out = metrics.rollup(topic_of().alias(TOPIC), "client_id").agg(
        F.grouping_id().alias("level"),
        F.sum("raw_events").alias("raw_events"),
        F.sum("unique_events").alias("unique_events"),
        F.sum("duplicate_events").alias("duplicate_events"),
    )
    return out.withColumn("duplicate_ratio", dup_ratio("duplicate_events", "raw_events"))


def ratio_round(dup, raw, digits: int = 2) -> Column:
    """Exact half-even rounding of dup/raw to ``digits`` places, in integers.

    Rounding the double instead would depend on the engine's rounding path."""
    d = F.col(dup) if isinstance(dup, str) else dup
    r = F.col(raw) if isinstance(raw, str) else raw
    scale = 10 ** digits
    num = d.cast("long") * F.lit(scale)
    q = idiv(num, r.cast("long"))
    rem = num - q * r
    up = (rem * 2 > r) | ((rem * 2 == r) & (q % 2 == 1))
    rounded = q + up.cast("long")
    return F.when(r == 0, F.lit(0.0)).otherwise(rounded.cast("double") / F.lit(float(scale)))


def topic_clients(metrics: DataFrame, topic: str) -> DataFrame:
    """One topic's clients, ratio to 2 places, most duplicates first."""
    m = metrics.filter(is_topic(topic))
    out = m.groupBy("client_id").agg(
        F.sum("raw_events").alias("raw"),
        F.sum("unique_events").alias("unique"),
        F.sum("duplicate_events").alias("duplicates"),
    )
    return out.withColumn("dup_ratio", ratio_round("duplicates", "raw", 2)).orderBy(F.desc("duplicates"))


def client_profile(events: DataFrame, client_col: str = "client_id") -> DataFrame:
    """Records per client."""
    return events.groupBy(client_col).agg(F.count(F.lit(1)).alias("records"))


def replay_client(metrics: DataFrame) -> DataFrame:
    """The highest-ratio row; ties go to the first in (topic, client) order."""
    return metrics.orderBy(F.desc("duplicate_ratio"), F.asc_nulls_first(TOPIC), F.asc_nulls_first("client_id")).limit(1)


def latest_metrics(metrics: DataFrame, n: int = 10) -> DataFrame:
    """L3: newest n metric rows (ties broken by topic, client)."""
    return metrics.orderBy(F.desc("batch_time"), F.asc(TOPIC), F.asc("client_id")).limit(n)


def topics(metrics: DataFrame) -> DataFrame:
    """Distinct topics in sorted order."""
    return metrics.select(topic_of().alias(TOPIC)).distinct().orderBy(TOPIC)

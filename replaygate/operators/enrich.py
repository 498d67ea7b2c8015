"""Decode, enrich, default, stamp and validate events (P1-P8, P12) and encode them for the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dedup_key
from ..functions.text import normalize_mode, topic_name
from ..schema import EVENT_SCHEMA, RAW_TOPIC

WIRE_FIELDS = [f.name for f in EVENT_SCHEMA.fields]
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def decode_events(raw: DataFrame, value_col: str = "value", topic_col: str = "topic") -> DataFrame:
    """Message bytes/text -> event columns, keeping the topic as ``kafka_topic``.

    A malformed message is kept as an all-NULL event (``is_malformed`` true);
    numbers in string fields become text, nested payload values become JSON
    text, and a payload that is not an object is NULL."""
    text = F.col(value_col).cast("string")
    dec = raw.select(F.col(topic_col).alias("kafka_topic"), text.alias("_json"),
                     F.from_json(text, EVENT_SCHEMA).alias("_e"), *[c for c in ("partition", "offset") if c in raw.columns])
    out = dec.select("kafka_topic", *[c for c in ("partition", "offset") if c in raw.columns],
                     *[F.col(f"_e.{f}").alias(f) for f in WIRE_FIELDS],
                     F.from_json(F.col("_json"), "map<string,string>").isNull().alias("is_malformed"))
    return out


def enrich_events(df: DataFrame, ingested_at=None) -> DataFrame:
    """Topic fallback, use-case fallback, event time (NULL when unparsable),
    ingestion time and the dedup key."""
    ing = F.current_timestamp() if ingested_at is None else (
        ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at).cast("timestamp"))
    topic = F.coalesce(F.col("source_topic"), F.col("kafka_topic")) if "kafka_topic" in df.columns else F.col("source_topic")
    out = df.withColumn("source_topic", topic)
    out = out.withColumn("use_case_id", F.coalesce(F.col("use_case_id"), F.col("source_topic"), F.lit(RAW_TOPIC)))
    out = out.withColumn("event_ts", F.try_to_timestamp(F.col("event_time")))
    out = out.withColumn("ingested_at", ing)
    return out.withColumn("dedup_key", dedup_key())


def apply_gateway_defaults(df: DataFrame, now=None) -> DataFrame:
    """A missing event_time becomes the gateway time as ISO-8601 text with offset."""
    if "event_time" not in df.columns:
        df = df.withColumn("event_time", F.lit(None).cast("string"))
    if "payload" not in df.columns:
        df = df.withColumn("payload", F.create_map().cast("map<string,string>"))
    for c in ("use_case_id", "source_topic"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    t = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now).cast("timestamp"))
    return df.withColumn("event_time", F.coalesce(F.col("event_time"), F.date_format(t, ISO_FORMAT)))


def stamp_use_case(df: DataFrame, use_case_name=None, mode=None, single_event: bool = False) -> DataFrame:
    """Stamp use case, topic and mode. Upload path: name and topic override
    the client's values; single-event path: topic forced to ``raw_events``."""
    m = F.lit(mode) if not isinstance(mode, Column) else mode
    out = df.withColumn("experiment_mode", normalize_mode(m))
    if single_event:
        return out.withColumn("source_topic", F.lit(RAW_TOPIC))
    name = use_case_name if isinstance(use_case_name, Column) else F.lit(use_case_name)
    return out.withColumn("use_case_id", name).withColumn("source_topic", topic_name(name))


def validate_events(df: DataFrame, required=("client_id", "event_type", "entity_id"), whole_upload: bool = False):
    """(valid rows, rejected rows with a ``reasons`` array).

    ``whole_upload``: reject everything when any row is invalid, as a request
    validator does (one scalar count decides; no rows go to the driver)."""
    reasons = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]),
                       lambda x: x.isNotNull())
    tagged = df.withColumn("_reasons", reasons)
    ok = tagged.filter(F.size("_reasons") == 0).drop("_reasons")
    bad = tagged.filter(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")
    if whole_upload:
        n_bad = bad.select(F.count(F.lit(1))).scalar()
        ok = ok.filter(n_bad == 0)
        bad = tagged.filter(n_bad > 0).withColumnRenamed("_reasons", "reasons")
    return ok, bad


def encode_events(df: DataFrame, topic_col: str = "source_topic", keep=()) -> DataFrame:
    """S6 payload: (topic, value) with the event as JSON, NULL fields written out, no
    key; the columns ``keep`` go along."""
    fields = [F.col(c) if c in df.columns else F.lit(None).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in WIRE_FIELDS]
    return df.select(F.col(topic_col).alias("topic"),
                     F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"), *keep)

"""Data model: event, metrics, limit, bucket and run schemas, and the admission policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced; do not tune.
#   default limit per minute   10000   (also the maximum)
#   minimum limit per minute   50
#   static limit per minute    1000
#   ratio tiers                < 0.05 -> 10000, < 0.30 -> 3000, < 0.70 -> 500, otherwise 50
#   experiment modes           none, static, storage_only, radar   ("radar" is the adaptive mode)
#   limit and bucket TTL       3600 seconds;  experiment run TTL  86400 seconds
#   metrics window             30 minutes;    event-time watermark  10 minutes
#   topic name                 prefix "usecase_", runs of [^a-zA-Z0-9_-] become "_",
#                              empty name becomes "upload", at most 80 characters
#   subscription pattern       raw_events|usecase_.*
#   health labels              ratio >= 0.5 "Replay risk", >= 0.15 "Watch", else "Healthy"
#   strategy labels            bypass_rate_limit (per event), bypass (per upload),
#                              static_token_bucket, radar_adaptive_token_bucket
#   baseline / protected guess (?i)round_1|baseline  and  (?i)round_2|protected
#   rejections kept per upload 20
# ---------------------------------------------------------------------------

MODES = ("none", "static", "storage_only", "radar")
BYPASS_MODES = ("none", "storage_only")
RAW_TOPIC = "raw_events"
TOPIC_PREFIX = "usecase_"
TOPIC_FALLBACK = "upload"
TOPIC_MAX_CHARS = 80
TOPIC_BAD_CHARS = r"[^a-zA-Z0-9_-]+"
SUBSCRIBE_PATTERN = r"raw_events|usecase_.*"
BASELINE_PATTERN = r"(?i)round_1|baseline"
PROTECTED_PATTERN = r"(?i)round_2|protected"
MAX_REJECTIONS = 20
UPLOAD_FALLBACK_NAME = "Uploaded Use Case"


@dataclass(frozen=True)
class Policy:
    default_limit: int = 10000
    max_limit: int = 10000
    min_limit: int = 50
    static_limit: int = 1000
    # (upper bound of the ratio, limit) in ascending order; ratios at or above the last cut get min_limit
    tiers: tuple = ((0.05, 10000), (0.30, 3000), (0.70, 500))
    limit_ttl_s: int = 3600
    bucket_ttl_s: int = 3600
    run_ttl_s: int = 86400
    window_minutes: int = 30
    watermark: str = "10 minutes"


DEFAULT_POLICY = Policy()

# Wire format of one event (request body / topic message). experiment_mode is
# stamped on use-case ingest; the original consumer schema dropped it.
EVENT_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("use_case_id", T.StringType()),
    T.StructField("source_topic", T.StringType()),
    T.StructField("experiment_mode", T.StringType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("batch_time", T.TimestampType()),
    T.StructField("use_case_topic", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("raw_events", T.LongType()),
    T.StructField("unique_events", T.LongType()),
    T.StructField("duplicate_events", T.LongType()),
    T.StructField("duplicate_ratio", T.DoubleType()),
    T.StructField("batch_id", T.LongType()),
])

LIMITS_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("limit_per_minute", T.IntegerType()),
    T.StructField("use_case_topic", T.StringType()),
    T.StructField("duplicate_ratio", T.DoubleType()),
    T.StructField("decided_at", T.TimestampType()),
    T.StructField("valid_until", T.TimestampType()),
])

BUCKET_SCHEMA = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("tokens", T.DoubleType()),
    T.StructField("last_refill", T.LongType()),
    T.StructField("limit_per_minute", T.IntegerType()),
    T.StructField("bucket_capacity", T.IntegerType()),
])

RUNS_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("experiment_mode", T.StringType()),
    T.StructField("total_events", T.LongType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()),
    T.StructField("saved_at", T.TimestampType()),
])

OFFSETS_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))

"""Input tables and the gateway-event views derived from them.

``gateway_events`` (``ge``) turns the ``events`` table into the event shape the
engine works on: one client per user, one topic per event type, entity ids
drawn from a small per-user range so that replays occur, a compressed time axis
(30 days -> 10 s, so token buckets actually run dry) and a deterministic
micro-batch number standing in for stream batches. ``replay_events``
(``ge_replay``) amplifies replays for the closed-loop experiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import dedup_key
from ..functions.policy import idiv
from ..session import prepare, table_path

# Fixture parameters (fixed): compression divisor of the time axis, events per
# stand-in micro-batch, replay copies per user class.
TIME_DIVISOR = 259200
BATCH_SIZE = 1000
REPLAY_COPIES = ((0, 20), (1, 3))  # (user_id % 5, copies); everyone else 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def _k(props="props"):
    return F.get_json_object(F.col(props), "$.k").try_cast("int")


def _base(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        "user_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client_id"),
        "event_type",
        _k().alias("k"),
        ts.alias("event_ts"),
        idiv(F.unix_micros(ts), TIME_DIVISOR).alias("us"),
        idiv("event_id", BATCH_SIZE).alias("batch_id"),
        "value",
        "props",
    )


def gateway_events(events: DataFrame, with_props: bool = False) -> DataFrame:
    """The ``ge`` view over the ``events`` table, on request with the raw ``props``."""
    b = _base(events)
    out = b.select(
        "event_id", "user_id", "client_id", "event_type",
        (F.col("k") % (F.lit(1) + F.col("user_id") % F.lit(100))).cast("string").alias("entity_id"),
        F.concat(F.lit("usecase_"), F.col("event_type")).alias("source_topic"),
        "event_ts", "us", "batch_id", "value",
        F.from_json(F.col("props"), "map<string,string>").alias("payload"),
        *(["props"] if with_props else []),
    )
    return out.withColumn("use_case_id", F.col("source_topic")).withColumn("dedup_key", dedup_key())


def load_ge(spark: SparkSession, sf_dir: str, with_props: bool = False) -> DataFrame:
    return gateway_events(read_table(spark, sf_dir, "events"), with_props)


def _replay_copies():
    copies = F.lit(1)
    for rem, n in reversed(REPLAY_COPIES):
        copies = F.when(F.col("user_id") % F.lit(5) == F.lit(rem), F.lit(n)).otherwise(copies)
    return copies


def replay_rows(events: DataFrame, topic: str) -> DataFrame:
    """The events of ``replay_events``, each once, with the number of its ``copies``."""
    out = _base(events).select(
        "event_id", "user_id", "client_id", "event_type",
        F.col("k").cast("string").alias("entity_id"),
        F.lit(topic).alias("source_topic"),
        "event_ts", "us", "batch_id", "value", _replay_copies().alias("copies"),
    )
    # the key is derived before an event is repeated
    return out.withColumn("use_case_id", F.col("source_topic")).withColumn("dedup_key", dedup_key())


def replay_events(events: DataFrame, topic: str) -> DataFrame:
    """The ``ge_replay`` view: entity = k, one topic, events of some users repeated."""
    out = replay_rows(events, topic)
    first = [c for c in out.columns if c not in ("use_case_id", "dedup_key", "copies")]
    return out.select(*first, F.explode(F.sequence(F.lit(0), F.col("copies") - F.lit(1))).alias("copy_no"), "use_case_id", "dedup_key")


def load_ge_replay(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    return replay_events(read_table(spark, sf_dir, "events"), topic)

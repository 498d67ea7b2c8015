"""C1 as a request: many uploads in one plan, each with a verdict and a response row.

An upload is rejected as a whole when its mode is unknown, its name is missing or
any of its events lacks a required field; the others are admitted through the
buckets they share. Every upload gets one response row, also one without events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import effective_limit, round_half_even, strategy_label
from ..functions.text import normalize_mode, topic_name
from ..schema import BYPASS_MODES, DEFAULT_POLICY, MAX_REJECTIONS, Policy
from .admission import token_bucket
from .enrich import apply_gateway_defaults, validate_events

INGESTED, BAD_MODE, BAD_REQUEST, BAD_EVENTS = "ingested", "invalid_experiment_mode", "missing_use_case_name", "invalid_events"


def rate_info(mode="experiment_mode", tokens="tokens", limit="limit_per_minute") -> Column:
    """What a decision reports: mode, strategy, tokens left (2 decimals), limit and
    capacity; NULL stands for unlimited in the bypass modes."""
    free = F.coalesce(F.col(mode).isin(*BYPASS_MODES), F.lit(False))
    limited = F.when(~free, F.col(limit).cast("int"))
    return F.struct(F.col(mode).alias("mode"), strategy_label(mode).alias("strategy"), F.when(~free, round_half_even(tokens, 2)).alias("tokens_remaining"),
                    limited.alias("limit_per_minute"), F.when(~free, F.greatest(F.lit(1), limited)).alias("bucket_capacity"))


def judge_uploads(requests: DataFrame, events: DataFrame) -> DataFrame:
    """``requests`` (upload_id, use_case_name, experiment_mode) with status, topic, the
    normalised mode, total_events and invalid_events."""
    _, bad = validate_events(events)
    totals = events.groupBy("upload_id").agg(F.count(F.lit(1)).alias("total_events"))
    invalid = bad.groupBy("upload_id").agg(F.count(F.lit(1)).alias("invalid_events"))
    mode = normalize_mode("experiment_mode")
    out = requests.select("upload_id", "use_case_name", mode.alias("experiment_mode")).join(totals, "upload_id", "left").join(invalid, "upload_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"total_events": F.coalesce("total_events", zero), "invalid_events": F.coalesce("invalid_events", zero)})
    status = (F.when(F.col("use_case_name").isNull(), F.lit(BAD_REQUEST)).when(F.col("experiment_mode").isNull(), F.lit(BAD_MODE))
              .when(F.col("invalid_events") > 0, F.lit(BAD_EVENTS)).otherwise(F.lit(INGESTED)))
    return out.withColumn("status", status).withColumn("topic", topic_name("use_case_name"))


def ingest_requests(requests: DataFrame, events: DataFrame, current_limits: DataFrame | None = None, initial: DataFrame | None = None, now=None,
                    policy: Policy = DEFAULT_POLICY, time_col: str = "us", order=("event_id",)) -> tuple[DataFrame, DataFrame]:
    """(responses, decided events). ``events``: upload_id, the event fields, ``time_col``
    and ``order``. Buckets are per (mode, client) across uploads, in time order;
    ``initial`` are stored ones. A response has upload_id, status, use_case_name, topic,
    experiment_mode, protection_strategy, total_events, accepted, rejected,
    invalid_events and the first rejections (client_id, entity_id, rate_info)."""
    judged = judge_uploads(requests, events)
    go = judged.filter(F.col("status") == INGESTED).select("upload_id", "use_case_name", "topic", "experiment_mode")
    ev = apply_gateway_defaults(events.drop("use_case_id", "source_topic", "experiment_mode"), now).drop("use_case_id", "source_topic").join(go, "upload_id")
    ev = ev.withColumnRenamed("use_case_name", "use_case_id").withColumnRenamed("topic", "source_topic")
    if current_limits is not None:
        ev = ev.join(current_limits.select("client_id", F.col("limit_per_minute").cast("string").alias("_stored")), "client_id", "left")
    else:
        ev = ev.withColumn("_stored", F.lit(None).cast("string"))
    ev = ev.withColumn("limit_per_minute", effective_limit("experiment_mode", F.col("_stored"), policy).cast("int")).drop("_stored")
    decided = token_bucket(ev, "limit_per_minute", time_col=time_col, order=order, mode="experiment_mode", steady=True, initial=initial)
    decided = decided.withColumn("rate_info", rate_info())
    counts = decided.groupBy("upload_id").agg(F.count_if("admitted").alias("accepted"), F.count_if(~F.col("admitted")).alias("rejected"))
    first = Window.partitionBy("upload_id").orderBy(time_col, *order)
    heads = (decided.filter(~F.col("admitted")).select("upload_id", "client_id", "entity_id", "rate_info", time_col, *order)
             .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= MAX_REJECTIONS))
    heads = heads.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "client_id", "entity_id", "rate_info"))).alias("_r"))
    out = judged.join(counts, "upload_id", "left").join(heads, "upload_id", "left")
    done = F.col("status") == INGESTED
    responses = out.select(
        "upload_id", "status", "use_case_name", "topic", "experiment_mode", F.when(done, strategy_label("experiment_mode", per_upload=True)).alias("protection_strategy"),
        "total_events", F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"), "invalid_events",
        F.transform(F.coalesce("_r", F.array().cast("array<struct<_rn:int,client_id:string,entity_id:string,rate_info:struct<mode:string,strategy:string,tokens_remaining:double,limit_per_minute:int,bucket_capacity:int>>>")),
                    lambda r: F.struct(r["client_id"].alias("client_id"), r["entity_id"].alias("entity_id"), r["rate_info"].alias("rate_info"))).alias("rejections"))
    return responses, decided

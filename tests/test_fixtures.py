"""Goldens from FIXTURES.md: small literal fixtures (own rows with the published
profiles) and the sf0.01 numbers of the driver tables."""

import os

from pyspark.sql import functions as F

from replaygate.functions import idiv, limit_for_ratio
from replaygate.operators import admission, limits, metrics
from replaygate.operators.enrich import stamp_use_case
from replaygate.functions import dedup_key
from replaygate.plans import pipelines as P
from replaygate.sources import io as IO
from replaygate.sources.tables import load_ge, read_table, replay_events

from conftest import SF01


def _csv_rows():
    rows = ["client_id,event_type,entity_id,payload", ""]
    for i in range(10):
        rows.append(f'seller_normal,order_created,N-{i},"{{""amount"": {100 + i}}}"')
    for i in range(10):
        rows.append(f'seller_replay , order_created , R-{i % 3} ,"{{""amount"": 5}}"')
    for i in range(5):
        rows.append(f"payment_gateway,payment_captured,P-{i % 3},")
    return "\n".join(rows) + "\n"


def test_csv_upload_metrics_and_tiers(spark, tmp_path):
    p = os.path.join(tmp_path, "upload.csv")
    with open(p, "w") as f:
        f.write(_csv_rows())
    ev = IO.read_events_csv(spark, p)
    ev = stamp_use_case(ev, "Replay Demo", "radar").withColumn("dedup_key", dedup_key())
    m = metrics.exact_metrics(ev).withColumn("lim", limit_for_ratio("duplicate_ratio"))
    got = {r.client_id: (r.raw_events, r.unique_events, r.duplicate_events, r.duplicate_ratio, r.lim)
           for r in m.collect()}
    assert got == {"payment_gateway": (5, 3, 2, 0.4, 500), "seller_normal": (10, 10, 0, 0.0, 10000),
                   "seller_replay": (10, 3, 7, 0.7, 50)}
    pay = {r.entity_id: r.payload for r in ev.filter("client_id = 'seller_normal'").collect()}
    assert pay["N-3"] == {"amount": "103"}
    assert ev.filter("client_id = 'payment_gateway'").first().payload == {}


def test_jsonl_and_simulator_profiles(spark, tmp_path):
    p = os.path.join(tmp_path, "u.jsonl")
    lines = ['{"client_id":"seller_normal","event_type":"order_created","entity_id":"A-%d","payload":{"amount":%d}}'
             % (i, i) for i in range(2)]
    lines += ['{"client_id":"seller_replay","event_type":"order_created","entity_id":"D-1","payload":{"amount":5}}'] * 3
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    ev = stamp_use_case(IO.read_events_jsonl(spark, p), "JSONL", "radar").withColumn("dedup_key", dedup_key())
    got = {r.client_id: (r.raw_events, r.unique_events) for r in metrics.exact_metrics(ev).collect()}
    assert got == {"seller_normal": (2, 2), "seller_replay": (3, 1)}
    # simulator profile: 20 unique + 20 identical
    sim = spark.range(40).select(
        F.when(F.col("id") < 20, "seller_normal").otherwise("seller_replay").alias("client_id"),
        F.lit("order_created").alias("event_type"),
        F.when(F.col("id") < 20, F.col("id").cast("string")).otherwise(F.lit("X")).alias("entity_id"),
        F.lit("raw_events").alias("source_topic")).withColumn("dedup_key", dedup_key())
    m = metrics.exact_metrics(sim).withColumn("lim", limit_for_ratio("duplicate_ratio"))
    got = {r.client_id: (r.raw_events, r.unique_events, r.duplicate_ratio, r.lim) for r in m.collect()}
    assert got == {"seller_normal": (20, 20, 0.0, 10000), "seller_replay": (20, 1, 0.95, 50)}


def _demo(spark):
    prof = [("heavy", 3000, 160), ("medium", 1500, 419), ("noisy", 1000, 817), ("alpha", 2500, 2500), ("beta", 2000, 2000)]
    parts = [spark.range(n).select(F.lit(c).alias("client_id"), (F.col("id") % u).cast("string").alias("entity_id"),
                                   F.col("id").alias("event_id")) for c, n, u in prof]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.select("*", F.lit("order_created").alias("event_type"), F.lit("usecase_round_1").alias("source_topic"),
                     F.lit(0).cast("long").alias("us"), F.lit(None).cast("timestamp").alias("event_ts")) \
        .withColumn("dedup_key", dedup_key())


def test_demo_round_one_and_burst(spark):
    ev = _demo(spark)
    m = metrics.exact_metrics(ev)
    assert m.agg(F.sum("duplicate_events")).first()[0] == 4104
    d = P.decide(m)
    lim = {r.client_id: r.limit_per_minute for r in d.current.collect()}
    assert lim == {"heavy": 50, "medium": 50, "noisy": 3000, "alpha": 10000, "beta": 10000}
    ev2 = limits.with_limits(ev, d.current)
    burst = admission.admit_burst(ev2, "limit_per_minute", order=("us", "event_id"))
    assert burst.filter("admitted").count() == 5600
    # zero elapsed time through the real bucket gives the same count
    tb = admission.token_bucket(ev2, "limit_per_minute", order=("event_id",))
    assert tb.filter("admitted").count() == 5600


def test_offsets_map(spark):
    df = spark.createDataFrame([({"usecase_1": {"0": 2461, "1": 2486, "2": 2547, "3": 2506},
                                  "usecase_2": {"0": 1453, "1": 1352, "2": 1460, "3": 1375}},)],
                               "offsets map<string, map<string, bigint>>")
    got = {r.topic: r.messages for r in admission.offsets_from_map(df).collect()}
    assert got == {"usecase_1": 10000, "usecase_2": 5640}


def test_client_in_two_topics_last_topic_wins(spark):
    dec = spark.createDataFrame([("c", "topic_a", 0.9, 50), ("c", "topic_b", 0.0, 10000)],
                                "client_id string, use_case_topic string, duplicate_ratio double, new_limit_per_minute int") \
        .withColumn("decided_at", F.lit("2024-01-01 00:00:00").cast("timestamp")) \
        .withColumn("valid_until", F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert limits.current_limits(dec).first().limit_per_minute == 10000


def test_token_bucket_goldens_sf001(spark):
    ge = load_ge(spark, SF01).select("event_id", "client_id", "us")
    assert admission.token_bucket(ge, 50).filter("admitted").count() == 8599
    ev = read_table(spark, SF01, "events").select(
        "event_id", F.col("event_type").alias("client_id"),
        idiv(F.unix_micros(F.col("ts").cast("timestamp")), 86400).alias("us"))
    got = [admission.token_bucket(ev, lim).filter("admitted").count() for lim in (1000, 500, 50)]
    assert got == [7495, 3745, 370]


def test_session_split_is_exact_on_real_gaps(spark):
    # real (uncompressed) time: users pause for minutes, so sessions do split
    ev = read_table(spark, SF01, "events").select(
        "event_id", F.concat(F.lit("t"), F.col("event_type")).alias("client_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a = admission.token_bucket(ev, 1, split_sessions=False).select("event_id", "admitted", "tokens")
    b = admission.token_bucket(ev, 1).select("event_id", "admitted", "tokens")
    assert a.count() == b.count() == 10000
    assert a.exceptAll(b).count() == 0


def test_session_split_with_zero_limit(spark):
    # limit 0: the bucket never refills, so a long gap must not start a fresh bucket
    ev = read_table(spark, SF01, "events").select(
        "event_id", F.concat(F.lit("t"), F.col("event_type")).alias("client_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.lit(2)).alias("lim"))
    a = admission.token_bucket(ev, "lim", split_sessions=False).select("event_id", "admitted", "tokens")
    b = admission.token_bucket(ev, "lim").select("event_id", "admitted", "tokens")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_closed_loop_goldens_sf001(spark):
    lp = P.closed_loop(read_table(spark, SF01, "events"))
    c = lp.comparison.first()
    assert (c.baseline_raw, c.baseline_duplicates, c.protected_raw, c.protected_duplicates) == (52376, 43021, 13188, 5520)
    assert round(c.load_reduction_pct, 2) == 74.82 and round(c.waste_reduction_pct, 2) == 87.17
    tiers = {r.limit_per_minute: r["count"] for r in lp.decisions.current.groupBy("limit_per_minute").count().collect()}
    assert tiers == {50: 33, 500: 27, 3000: 69, 10000: 21}
    r2 = limits.with_limits(replay_events(read_table(spark, SF01, "events"), P.ROUND_2), lp.decisions.current)
    burst = admission.admit_burst(r2, "limit_per_minute", order=("us", "event_id", "copy_no"))
    assert burst.filter("admitted").count() == 12928

"""Streams: decode edge rows, stream = batch for the bucket, watermark behaviour,
restart from checkpoint, idempotent metrics batches."""

import os

from pyspark.sql import functions as F

from replaygate.operators import admission
from replaygate.operators.enrich import decode_events, enrich_events
from replaygate.sources import io as IO
from replaygate.sources.tables import load_ge
from replaygate.streaming import admission as SA
from replaygate.streaming import dedup as SD
from replaygate.streaming import pipeline as SP

from conftest import SF001


def test_decode_edge_rows(spark):
    vals = ["not json", "[]", "",
            '{"client_id":5,"event_type":"e","entity_id":"x"}',
            '{"client_id":"a","payload":"str","event_type":"e","entity_id":"y"}',
            '{"client_id":"a","payload":{"x":{"y":[1,2]}},"event_type":"e","entity_id":"z"}',
            '{"client_id":"a","event_time":"garbage","event_type":"e","entity_id":"w"}',
            '{"client_id":"a","event_time":"2024-01-01T00:00:00+00:00","event_type":"e","entity_id":"v"}']
    raw = spark.createDataFrame([("usecase_t", v) for v in vals], "topic string, value string")
    rows = enrich_events(decode_events(raw), ingested_at="2024-01-01 00:00:00").collect()
    bad = rows[:3]
    assert all(r.is_malformed and r.client_id is None and r.source_topic == "usecase_t" for r in bad)
    assert len({r.dedup_key for r in bad}) == 1
    assert rows[3].client_id == "5" and not rows[3].is_malformed
    assert rows[4].payload is None and rows[4].entity_id == "y"
    assert rows[5].payload["x"].replace(" ", "") == '{"y":[1,2]}'
    assert rows[6].event_ts is None
    assert str(rows[7].event_ts) == "2024-01-01 00:00:00"


def _run_available(q):
    q.awaitTermination()
    assert q.exception() is None


def test_stream_bucket_equals_batch(spark, tmp_path):
    src, out, ck = (os.path.join(tmp_path, d) for d in ("src", "out", "ck"))
    ge = load_ge(spark, SF001).select("event_id", "client_id", "us", F.lit(50).alias("limit_per_minute"))
    # three micro-batches, in time order, each its own run from the same checkpoint
    for lo, hi in ((0, 300), (300, 700), (700, 10 ** 9)):
        ge.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).write.mode("append").parquet(src)
        s = spark.readStream.schema(ge.schema).parquet(src)
        q = (SA.admit_stream(s, ttl_s=None).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        _run_available(q)
    got = spark.read.parquet(out).select("event_id", "admitted", "tokens")
    want = admission.token_bucket(ge, "limit_per_minute").select("event_id", "admitted", "tokens")
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).count() == 0


def _ev(spark, rows):
    return spark.createDataFrame(rows, "dedup_key string, event_ts timestamp")


def _dedup_runs(spark, tmp_path, batches, fn):
    src, out, ck = (os.path.join(tmp_path, d) for d in ("src", "out", "ck"))
    for b in batches:
        _ev(spark, b).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("dedup_key string, event_ts timestamp").parquet(src)
        q = (fn(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        _run_available(q)
    return sorted(r.dedup_key for r in spark.read.parquet(out).collect())


def test_late_row_dropped(spark, tmp_path):
    import datetime as dt
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [[("a", t(0, 0))], [("b", t(5, 0))], [("c", t(5, 1))], [("d", t(0, 30))], [("e", t(5, 2))]]
    got = _dedup_runs(spark, tmp_path, batches, SD.dedup_stream)
    assert "d" not in got and {"a", "b", "c"} <= set(got)


def test_resent_key_after_horizon(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    later = t0 + dt.timedelta(hours=9)
    batches = [[("a", t0)], [("b", later)], [("x", later)], [("a", later)], [("y", later)]]
    keep_forever = _dedup_runs(spark, os.path.join(tmp_path, "f"), batches, SD.dedup_stream)
    bounded = _dedup_runs(spark, os.path.join(tmp_path, "w"), batches, SD.dedup_stream_bounded)
    assert keep_forever.count("a") == 1
    assert bounded.count("a") == 2


def test_pipeline_restart_and_idempotent_metrics(spark, tmp_path):
    topics, clean, met, ck = (os.path.join(tmp_path, d) for d in ("topics", "clean", "metrics", "ck"))
    ge = load_ge(spark, SF001).select("event_id", "client_id", "event_type", "entity_id", "source_topic",
                                      F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("event_time"))
    for lo, hi in ((0, 500), (500, 10 ** 9)):
        IO.write_events(ge.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)), fmt="files", path=topics)
        p = SP.start_pipeline(spark, clean, met, fmt="files", source_path=topics, checkpoint_dir=ck,
                              trigger={"availableNow": True})
        p.clean.awaitTermination()
        p.metrics.awaitTermination()
    out = spark.read.parquet(clean)
    n_files = len(out.inputFiles())
    assert SP.compact_table(spark, clean, os.path.join(tmp_path, "compacted")) == 1 < n_files
    assert spark.read.parquet(os.path.join(tmp_path, "compacted")).count() == out.count()
    assert out.count() == out.select("dedup_key").distinct().count() == ge.select(
        F.sha2(F.concat_ws(":", "source_topic", "client_id", "event_type", "entity_id"), 256)).distinct().count()
    m = IO.read_metrics(spark, met)
    assert m.agg(F.sum("raw_events")).first()[0] == 1000
    assert m.select("batch_id").distinct().count() >= 2
    # replaying a batch id overwrites it
    writer = SP.metrics_batch_writer(met, batch_time="2024-01-01 00:00:00")
    batch = SP.enrich_events(SP.decode_events(spark.read.schema("value string, topic string").text(topics)))
    writer(batch, 0)
    writer(batch, 0)
    m2 = IO.read_metrics(spark, met)
    assert m2.filter("batch_id = 0").agg(F.sum("raw_events")).first()[0] == 1000


def test_subscription_pattern_and_bounded_read(spark, tmp_path):
    topics = os.path.join(tmp_path, "topics")
    rows = [(t, f"e{i}", "x", f"k{i % 3}") for t in ("usecase_a", "raw_events", "other", "xusecase_b")
            for i in range(5)]
    df = spark.createDataFrame(rows, "source_topic string, client_id string, event_type string, entity_id string")
    IO.write_events(df, fmt="files", path=topics)
    s = SP.event_stream(spark, "files", path=topics)
    out, ck = os.path.join(tmp_path, "o"), os.path.join(tmp_path, "ck")
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
        .trigger(availableNow=True).start()
    _run_available(q)
    got = {r.kafka_topic for r in spark.read.parquet(out).select("kafka_topic").distinct().collect()}
    assert got == {"usecase_a", "raw_events"}
    assert IO.read_topic(spark, "usecase_a", fmt="files", path=topics).count() == 5
    assert IO.read_topic(spark, "usecase_a", fmt="files", path=topics, n=3).count() == 3

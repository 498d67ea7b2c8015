"""Cases that a green oracle row does not show: no cap, no lost rows, NULL keys, upload rules."""

import pytest
from pyspark.sql import functions as F

from replaygate.functions.policy import to_number
from replaygate.operators import admission, dedup, filters, metrics
from replaygate.plans import pipelines as P
from replaygate.sources import io


def test_burst_has_no_cap_and_keeps_null_clients(spark):
    ev = spark.range(30000).select(F.when(F.col("id") < 20000, "a").otherwise(None).alias("client_id"), F.col("id").alias("event_id"), F.lit(0).cast("long").alias("us"))
    got = {r.client_id: r.n for r in admission.admit_burst(ev, 15000, order=("us", "event_id")).filter("admitted").groupBy("client_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 15000, None: 10000}


def test_bucket_keeps_null_clients_and_null_modes(spark):
    ev = spark.createDataFrame([(i, None, i, None) for i in range(5)] + [(9, "a", 0, "none")], "event_id long, client_id string, us long, mode string")
    for split in (True, False):
        assert admission.token_bucket(ev.filter("event_id < 9"), 1, split_sessions=split).filter("admitted").count() == 1
        out = admission.token_bucket(ev, 1, mode="mode", split_sessions=split)
        assert out.count() == 6 and out.filter("admitted").count() == 2


def test_replays_with_their_originals_id(spark):
    rows = [("k", 1, 0)] * 4 + [("k", 2, 5), ("j", 1, 0), ("n", None, 1), ("n", None, 1)]
    got = dedup.duplicate_events(spark.createDataFrame(rows, "dedup_key string, event_id long, event_ts long")).collect()
    assert sorted((r.dedup_key, r.event_id or 0) for r in got) == [("k", 1)] * 3 + [("k", 2), ("n", 0)][0:1] + [("n", 0)]


def test_ingest_rejects_a_bad_mode(spark):
    ev = spark.createDataFrame([("a", "t", "e", 0, 1)], "client_id string, event_type string, entity_id string, us long, event_id long")
    with pytest.raises(ValueError):
        P.ingest(ev, "x", "foo")


def test_decisions_have_a_time(spark):
    m = spark.createDataFrame([("t", "c", 10, 5, 5, 0.5)], "use_case_topic string, client_id string, raw_events long, unique_events long, duplicate_events long, duplicate_ratio double")
    r = P.decide(m).decisions.collect()[0]
    assert r.decided_at is not None and r.valid_until > r.decided_at


def test_numbers_need_a_number(spark):
    values = ["5d", "1f", "12", " 1.5e3 ", "NaN", "Infinity", "", None, "-.5", "0x10"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(to_number("v").alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 12, 1500, 0, 0, 0, 0, -0.5, 0]


def test_csv_files_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('client_id,event_type,entity_id\n" c1 ",order,E1\n\nc9,"a ""b""",E9\n')
    (tmp_path / "b.csv").write_text("entity_id,client_id,event_type,event_time\nE2,c2,order,2024-01-01T00:00:00Z\n")
    got = sorted((r.client_id, r.event_type, r.entity_id, r.event_time) for r in io.read_events_csv(spark, str(tmp_path)).collect())
    assert got == [("c1", "order", "E1", None), ("c2", "order", "E2", "2024-01-01T00:00:00Z"), ("c9", 'a "b"', "E9", None)]


def test_json_upload_must_be_an_array(spark, tmp_path):
    (tmp_path / "ok.json").write_text(' [{"client_id": "a", "event_type": "t", "entity_id": "e"},\n {"client_id": "b", "event_type": "t", "entity_id": "f"}]')
    assert [r.client_id for r in io.read_events_json_array(spark, str(tmp_path / "ok.json")).collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text('{"client_id": "a"}')
    with pytest.raises(Exception, match="array"):
        io.read_events_json_array(spark, str(tmp_path / "bad.json")).collect()


def test_topic_predicates_are_pushed(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("x", "c", 1), (None, "c", 1)], "use_case_topic string, client_id string, raw_events long").write.parquet(path)
    df = spark.read.parquet(path)
    plan = filters.for_topic(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(use_case_topic,x)" in plan
    assert filters.for_topic(df, "raw_events").count() == 1 and metrics.is_topic("x") is not None


def test_csv_fields_beyond_many_columns_are_read(spark, tmp_path):
    more = [f"x{i}" for i in range(90)]
    (tmp_path / "wide.csv").write_text("\n" + ",".join(["client_id", '"a,b"', *more, "entity_id", "event_type"]) + "\n" + ",".join(["c1", "q", *more, "E1", "order"]) + "\n")
    (tmp_path / "narrow.csv").write_text("entity_id,client_id,event_type\nE2,c2,order\n")
    got = sorted((r.client_id, r.event_type, r.entity_id) for r in io.read_events_csv(spark, str(tmp_path)).collect())
    assert got == [("c1", "order", "E1"), ("c2", "order", "E2")]

"""Scalar expressions against hand-checked edge rows."""

import hashlib

from pyspark.sql import functions as F

from replaygate.functions import (dedup_key, dup_ratio, effective_limit, health_label, limit_for_ratio,
                                  normalize_mode, parse_payload, percent_text, strategy_label, to_number,
                                  topic_name, use_case_from_path)


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_dedup_key_null_part_and_separator(spark):
    rows = [("raw_events", None, "a", "b"), ("t", "a:b", "c", None), ("t", "a", "b:c", None)]
    got = one(spark, dedup_key("source_topic", "client_id", "event_type", "entity_id"), rows,
              "source_topic string, client_id string, event_type string, entity_id string")
    assert got[0] == hashlib.sha256(b"raw_events:a:b").hexdigest()
    assert got[1] == got[2]  # ':' is not escaped


def test_tier_edges(spark):
    got = one(spark, limit_for_ratio("r"), [(0.0,), (0.05,), (0.30,), (0.70,), (-1.0,), (2.0,), (0.049,)], "r double")
    assert got == [10000, 3000, 500, 50, 10000, 50, 10000]


def test_topic_names(spark):
    got = one(spark, topic_name("n"), [("  A b!c--d ",), ("***",), ("x" * 100,), ("Replay Attack Demo",)], "n string")
    assert got == ["usecase_a_b_c--d", "usecase_upload", "usecase_" + "x" * 80, "usecase_replay_attack_demo"]


def test_modes(spark):
    got = one(spark, normalize_mode("m"), [(None,), ("",), (" RADAR ",), ("   ",), ("foo",), ("Static",)], "m string")
    assert got == ["radar", "radar", "radar", None, None, "static"]


def test_ratio_zero_raw(spark):
    got = one(spark, dup_ratio("d", "r"), [(0, 0), (3, 4)], "d long, r long")
    assert got == [0.0, 0.75]


def test_effective_limit_and_strategy(spark):
    rows = [("none", None), ("storage_only", "50"), ("static", "50"), ("radar", None), ("radar", "10.9"),
            ("radar", "3000")]
    got = one(spark, effective_limit("m", "s"), rows, "m string, s string")
    assert got == [10000, 10000, 1000, 10000, 50, 3000]
    lab = one(spark, strategy_label("m"), rows, "m string, s string")
    assert lab[:3] == ["bypass_rate_limit", "bypass_rate_limit", "static_token_bucket"]
    assert lab[3] == "radar_adaptive_token_bucket"
    up = one(spark, strategy_label("m", per_upload=True), rows[:1], "m string, s string")
    assert up == ["bypass"]


def test_health_and_percent(spark):
    assert one(spark, health_label("r"), [(0.5,), (0.15,), (0.149,), ("x",)], "r string") == \
        ["Replay risk", "Watch", "Healthy", "Healthy"]
    got = one(spark, percent_text("d", "r"), [(1, 16), (0, 0), (2840, 3000), (1, 3)], "d long, r long")
    assert got == ["6.3%", "0.0%", "94.7%", "33.3%"]


def test_payload_and_numbers(spark):
    got = one(spark, parse_payload("p"), [("",), ("not json",), ('{"a": 1, "b": {"c": [1]}}',), (None,)], "p string")
    assert got[0] == {} and got[1] == {"value": "not json"} and got[3] == {}
    assert got[2]["a"] == "1" and got[2]["b"].replace(" ", "") == '{"c":[1]}'
    assert one(spark, to_number("x"), [("abc",), ("NaN",), ("5",), ("Infinity",)], "x string") == [0.0, 0.0, 5.0, 0.0]


def test_use_case_from_path(spark):
    got = one(spark, use_case_from_path("p"), [("/up/demo_upload.csv",), ("/up/.csv",), ("a.b.json",)], "p string")
    assert got == ["demo_upload", "Uploaded Use Case", "a.b"]

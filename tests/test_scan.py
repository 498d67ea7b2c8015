"""Running values in blocks, the as-of join and distinct sketches, against plain loops."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from replaygate.operators import dedup, limits, metrics
from replaygate.operators.scan import plus, running_before
from replaygate.schema import Policy


def test_running_values_equal_a_loop(spark):
    rng = random.Random(0)
    rows = sorted({(rng.choice(["a", "b", None]), rng.randrange(-200, 200)) for _ in range(300)}, key=str)
    rows = [(k, i, None if rng.random() < 0.1 else rng.randrange(50)) for k, i in rows]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for block in (1, 7, 4096):
        top = running_before(df, "i", "v", keys=("k",), block=block).collect()
        total = running_before(df, "i", "v", keys=("k",), combine=F.sum, both=plus, block=block).collect()
        for got, fold in ((top, max), (total, sum)):
            assert len(got) == len(rows)
            for r in got:
                earlier = [v for k, i, v in rows if k == r.k and i < r.i and v is not None]
                assert r.before == (fold(earlier) if earlier else None)
    alone = running_before(df.groupBy("i").agg(F.max("v").alias("v")), "i", "v", block=16).collect()
    assert all(r.before == max((v for _, i, v in rows if i < r.i and v is not None), default=None) for r in alone)
    assert running_before(df.limit(0), "i", "v").collect() == []


def test_no_window_goes_over_all_batches(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("batch_id"), F.timestamp_seconds("id").alias("event_ts"))
    plan = dedup.late_events(df)._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((\w+)#", plan)
    assert specs and "batch_id" not in specs  # batches are windowed inside their block, blocks by their totals


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_asof_join_equals_a_search(spark):
    rng = random.Random(1)
    policy = Policy(limit_ttl_s=5000)
    events = [(i, rng.choice(["a", "b", "c", None]), None if i % 40 == 0 else at(rng.randrange(40_000))) for i in range(400)]
    told = [(rng.choice(["a", "b", None]), f"t{i % 3}", rng.choice([10, 50, 3000]), s, at(s), at(s + 5000)) for i, s in enumerate(rng.choices(range(40_000), k=25) * 2)]
    history = spark.createDataFrame(told, "client_id string, use_case_topic string, new_limit_per_minute int, s int, decided_at timestamp, valid_until timestamp")
    ev = spark.createDataFrame(events, "event_id long, client_id string, event_ts timestamp")
    got = {r.event_id: r for r in limits.with_limits_asof(ev, history, policy=policy).collect()}
    assert len(got) == 400
    found = 0
    for i, c, t in events:
        known = [(d, topic, lim, until) for cc, topic, lim, _, d, until in told if cc is not None and cc == c and t is not None and d <= t]
        best = max(known) if known else None
        valid = best is not None and t < best[3]
        found += valid
        assert got[i].limit_per_minute == (max(50, best[2]) if valid else 10000)
        assert got[i].decided_at == (best[0] if valid else None)
    assert found > 100


def test_sketches_add_up_across_batches(spark):
    df = spark.range(60_000).select((F.col("id") % 6).alias("batch_id"), F.lit("t").alias("source_topic"), (F.col("id") % 2).cast("string").alias("client_id"),
                                    (F.col("id") % 9001).cast("string").alias("dedup_key"))
    exact = {r.client_id: r for r in metrics.exact_metrics(df).collect()}
    parts = metrics.sketched_metrics(df)
    for r in metrics.merged_metrics(parts).collect():
        assert r.raw_events == exact[r.client_id].raw_events
        assert abs(r.unique_events - exact[r.client_id].unique_events) <= 4 * 0.83 / 2 ** 7 * exact[r.client_id].unique_events
    assert parts.count() == 6
    few = metrics.merged_metrics(metrics.sketched_metrics(df.filter("id < 10"))).collect()
    assert all(r.unique_events == r.raw_events == 5 for r in few)
    assert metrics.merged_metrics(metrics.sketched_metrics(df.limit(0))).collect() == []

"""What is kept between batches: chunked buckets, stores, live limits, logs, uploads as requests."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from replaygate.operators import admission, bucket, requests
from replaygate.plans import pipelines as P
from replaygate.sources import io as IO
from replaygate.sources import store as ST
from replaygate.streaming import admission as SA
from replaygate.streaming import dedup as SD
from replaygate.streaming import live as SL

NOW = {"availableNow": True}


def chunk_map(us, limit):
    k, cap = len(us), bucket.capacity(limit)
    refill = [(t - us[0]) * limit for t in us]
    spare = min(r - (i + 1) * bucket.TOKEN for i, r in enumerate(refill)) + k * bucket.TOKEN
    cut = min(cap - r + i * bucket.TOKEN for i, r in enumerate(refill))
    return k, refill[-1], spare, cut


@pytest.mark.parametrize("limit", [2, 3, 7, 50, 1000])
def test_four_numbers_are_the_map_of_a_chunk(limit):
    rng = random.Random(limit)
    for _ in range(150):
        us = sorted(rng.randrange(bucket.CHUNK_US) for _ in range(rng.choice([1, 2, 5, 40])))
        if rng.random() < 0.3:
            us = sorted(us + [us[0]] * rng.randrange(3 * limit if limit < 20 else 60))
        parts = chunk_map(us, limit)
        levels = [0, bucket.TOKEN - 1, bucket.TOKEN, bucket.capacity(limit), parts[3], max(0, parts[3] - 1)]
        for level in [min(x, bucket.capacity(limit)) for x in levels] + [rng.randrange(bucket.capacity(limit) + 1) for _ in range(30)]:
            # the same level right before the first event: refilled from it in no time
            want = bucket.bucket_fold(us, [limit] * len(us), level, us[0])[2]
            assert bucket.pass_chunk(level, *parts) == want


def random_events(seed, clients=25):
    rng, rows = random.Random(seed), []
    for c in range(clients):
        t, limit, mean = rng.randrange(10**9) - 3 * 10**8, rng.choice([0, 1, 2, 3, 50]), rng.choice([10**3, 10**5, 10**6, 6 * 10**7, 10**9])
        for _ in range(120):
            t += int(rng.expovariate(1 / mean)) if rng.random() > 0.1 else 0
            t += 3600 * 10**6 if rng.random() < 0.01 else 0
            limit = rng.choice([0, 1, 2, 5, 500]) if c % 3 == 0 and rng.random() < 0.1 else limit
            rows.append((len(rows), None if c == 4 else f"c{c}", t, limit))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_chunks_decide_as_one_serial_fold(spark, seed):
    df = spark.createDataFrame(random_events(seed), "event_id long, client_id string, us long, lim int")
    a, b = admission.token_bucket(df, "lim", split_sessions=False), admission.token_bucket(df, "lim")
    assert a.count() == b.count() == 3000 and a.exceptAll(b).count() == 0
    steady = df.filter("substring(client_id, 2) % 3 <> 0")
    a, b = admission.token_bucket(steady, "lim", split_sessions=False), admission.token_bucket(steady, "lim", steady=True)
    assert a.exceptAll(b).count() == 0


def test_one_busy_client_is_decided_in_several_tasks(spark):
    # 200,000 rows are too few to be left apart by themselves
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(200_000).select(F.lit("hot").alias("client_id"), F.col("id").alias("event_id"), (F.col("id") * 5000).alias("us"))
        out = admission.token_bucket(df, 3000).withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("task").agg(F.count_if("admitted").alias("n"), F.sum("tokens")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(tasks) > 4
    assert sum(r.n for r in tasks) == sum(bucket.bucket_fold(range(0, 10**9, 5000), [3000] * 200_000, 0, None)[0])


def test_missing_times_and_limits(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", 6000, None), (3, "a", 6001, None)], "event_id long, client_id string, us long, lim int")
    assert [r.admitted for r in admission.token_bucket(df, "lim").orderBy("event_id").collect()] == [True, True, False]  # 6 ms at the default limit refill one token


def test_two_uploads_equal_one(spark, tmp_path):
    df = spark.createDataFrame(random_events(7), "event_id long, client_id string, us long, lim int")
    df = df.withColumn("lim", F.greatest("lim", F.lit(1))).withColumn("experiment_mode", F.when(F.col("event_id") % 2 == 0, "static").otherwise("radar"))
    df = df.withColumn("limit_per_minute", F.col("lim"))
    whole = admission.token_bucket(df, "lim", mode="experiment_mode")
    store = ST.bucket_store(spark, str(tmp_path / "buckets"))
    parts = []
    for cond in ("us < 400000000", "us >= 400000000 and us < 3000000000", "us >= 3000000000"):
        done = admission.token_bucket(df.filter(cond), "lim", mode="experiment_mode", initial=store.read())
        done.write.parquet(str(tmp_path / f"u{len(parts)}"))
        parts.append(spark.read.parquet(str(tmp_path / f"u{len(parts)}")))
        store.upsert(P.bucket_state(parts[-1], order=("event_id",)))
    got = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(whole.columns)
    assert got.count() == whole.count() and got.exceptAll(whole).count() == 0
    want = P.bucket_state(whole, order=("event_id",)).select("experiment_mode", "client_id", "tokens", "last_refill")
    assert store.read().select(want.columns).exceptAll(want).count() == 0
    carried = P.buckets_after(parts[2], store.read(), order=("event_id",))
    assert carried.count() == store.read().count()


ROW = "topic string, experiment_mode string, total_events long, accepted long, rejected long, saved_at string"


def test_store_keeps_one_row_a_key_and_hides_a_broken_write(spark, tmp_path):
    store = ST.run_store(spark, str(tmp_path / "runs"))
    assert store.read().count() == 0 and store.upsert(spark.createDataFrame([], ROW)) == 0

    def rows(day, n=20, accepted=0):
        return spark.createDataFrame([(f"t{i}" if i else None, "radar", 1, accepted, 0, f"2024-01-{day:02} 00:00:00") for i in range(n)], ROW)
    for day in range(1, 8):
        store.upsert(rows(day, accepted=day))
        assert [r.accepted for r in store.read().select("accepted").distinct().collect()] == [day] and store.read().count() == 20
    files = len(list((tmp_path / "runs").glob("slot=*/part=*/*.parquet")))
    assert files <= 2 * store.parts  # as many after seven upserts as after two
    store.upsert(rows(1, n=3, accepted=99))  # older rows change nothing
    assert store.read().filter("accepted = 99").count() == 0
    store.upsert(rows(20, n=3, accepted=5))  # a part of the keys
    assert sorted((r.accepted, r["count"]) for r in store.read().groupBy("accepted").count().collect()) == [(5, 3), (7, 17)]

    version, broken = store.manifest()[0], ST.run_store(spark, str(tmp_path / "runs"))
    broken._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.upsert(rows(25, accepted=1000))
    assert store.manifest()[0] == version and store.read().filter("accepted = 1000").count() == 0
    store.upsert(rows(26, n=20, accepted=4))
    assert [r.accepted for r in store.read().select("accepted").distinct().collect()] == [4]


def test_store_drops_expired_rows_with_their_parts(spark, tmp_path):
    store = ST.run_store(spark, str(tmp_path / "runs"))
    old = spark.createDataFrame([(f"t{i}", "radar", 1, 0, 0, "2024-01-01 00:00:00") for i in range(40)], ROW)
    store.upsert(old)
    store.upsert(old)
    store.upsert(old, keep=F.col("saved_at") > "2024-02-01")
    assert store.read().count() == 0


def test_metric_dates_prune_and_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    m = spark.createDataFrame([(f"2024-01-{d:02} 12:00:00", "t", "c", 3, 2, 1, 1 / 3, d) for d in range(1, 9)],
                              "batch_time string, use_case_topic string, client_id string, raw_events long, unique_events long, duplicate_events long, duplicate_ratio double, batch_id long").withColumn("batch_time", F.col("batch_time").cast("timestamp"))
    IO.write_metrics_by_date(m, path)
    IO.write_metrics_by_date(m.filter("batch_id = 3"), path)
    assert spark.read.parquet(path).count() == 8
    late = IO.read_metrics_by_date(spark, path, since="2024-01-07 00:00:00")
    assert late.count() == 2 and IO.read_metrics_by_date(spark, path, until="2024-01-02 00:00:00").count() == 1
    filters = late._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert "metrics_date" in filters.split("]")[0]


def test_log_offsets_follow_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a" if i % 3 else "b", "c", "t", str(i), i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "source_topic string, client_id string, event_type string, entity_id string, us long, event_id long")
    IO.write_log(df.filter("us < 60"), path, partition=F.col("event_id") % 2)
    IO.write_log(df.filter("us >= 60"), path, partition=F.col("event_id") % 2)
    got = {}
    for r in IO.read_log(spark, path).withColumn("e", F.get_json_object("value", "$.entity_id").cast("int")).collect():
        got.setdefault((r.topic, r.partition), []).append((r.offset, r.e))
    for (topic, part), seen in got.items():
        want = [i for i in range(100) if (i % 3 == 0) == (topic == "b") and i % 2 == part]
        assert sorted(seen) == list(enumerate(want))
    head = [r.value for r in IO.read_topic(spark, "a", fmt="log", path=path, n=5).collect()]
    assert len(head) == 5 and [r.messages for r in admission.offset_totals(IO.read_log(spark, path)).orderBy("topic").collect()] == [66, 34]


def test_first_messages_of_text_files_are_their_first_lines(spark, tmp_path):
    path = str(tmp_path / "topics")
    rows = [("a", "c", "t", f"{i:03}", i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "source_topic string, client_id string, event_type string, entity_id string, us long, event_id long")
    IO.write_events(df.coalesce(1).sortWithinPartitions("us"), fmt="files", path=path)
    head = IO.read_topic(spark, "a", fmt="files", path=path, n=5)
    assert head.columns == ["topic", "value"]
    assert [r[0] for r in head.select(F.get_json_object("value", "$.entity_id")).collect()] == ["000", "001", "002", "003", "004"]
    assert IO.read_topic(spark, "a", fmt="files", path=path).count() == 50


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def at(us):
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


EV, DEC = "event_id long, client_id string, us long, mode string", SL.DECISION_ROWS


def test_limits_reach_the_running_stream(spark, tmp_path):
    src, told, out, ck = (str(tmp_path / d) for d in ("src", "told", "out", "ck"))
    minute = 60_000_000
    batches = [
        ([(i, "a", 0, "radar") for i in range(60)] + [(100, "b", 0, None)], [("z", 50, 0, minute)]),
        # a decision in between: 60 events a microsecond apart, cut to 50 from the 11th on
        ([(200 + i, "a", minute + i, "radar") for i in range(70)] + [(300, "a", minute, "none"), (301, "a", minute, "static")], [("a", 50, minute + 10, 10 * minute)]),
        # the decision has expired: the default again
        ([(400 + i, "a", 20 * minute + i, "radar") for i in range(70)], [("a", 60, 30 * minute, 40 * minute)]),
    ]
    for events, decisions in batches:
        e, d = _stream(spark, events, EV, src), _stream(spark, decisions, DEC, told)
        SL.start_admitting(e, d, out, ck, NOW, mode_col="mode").awaitTermination()
    rows = {r.event_id: r for r in spark.read.parquet(out).collect()}
    assert len(rows) == 203 and all(rows[i].admitted and rows[i].limit_per_minute == 10000 for i in range(60))
    assert [rows[200 + i].limit_per_minute for i in range(12)] == [10000] * 10 + [50] * 2
    assert sum(rows[200 + i].admitted for i in range(70)) == 60 and rows[269].admitted is False
    assert rows[300].tokens is None and rows[301].limit_per_minute == 1000 and rows[301].tokens == 999
    assert all(rows[400 + i].admitted for i in range(70))


def test_idle_buckets_leave_the_state_and_change_nothing(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("src", "out", "ck"))
    schema = "event_id long, client_id string, us long, limit_per_minute int, event_ts timestamp"
    hour = 3600 * 1_000_000

    def rows(h, clients):
        return [(h * 100 + i, c, (h + 1) * hour + i, 2, at((h + 1) * hour + i)) for i, c in enumerate(clients)]
    left = []
    for h, clients in enumerate((["a", "a", "a", "b"], ["c"], ["c"], ["c"], ["c", "a"])):
        stream = _stream(spark, rows(h, clients), schema, src).withWatermark("event_ts", "10 minutes")
        q = (SA.admit_stream(stream, event_time_col="event_ts").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "buckets").load(ck)
        left.append(sorted(r[0] for r in state.select("key.client_id").distinct().collect()))
    got = [(r.event_id, r.admitted) for r in spark.read.parquet(out).orderBy("event_id").collect()]
    assert got == [(0, True), (1, True), (2, False), (3, True), (100, True), (200, True), (300, True), (400, True), (401, True)]
    assert left[0] == ["a", "b"] and "b" not in left[-1] and "a" in left[-1]


def test_bounded_dedup_state_goes(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("src", "out", "ck"))
    held = []
    for h, key in enumerate(("a", "b", "c", "a")):
        stream = SD.dedup_stream_bounded(_stream(spark, [(key, at((h + 1) * 3600 * 10**6))], "dedup_key string, event_ts timestamp", src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        held.append(sorted(r[0] for r in spark.read.format("statestore").load(ck).select("key.dedup_key").collect()))
    assert sorted(r.dedup_key for r in spark.read.parquet(out).collect()) == ["a", "a", "b", "c"]
    assert "a" not in held[2]


def test_wrong_state_store_is_refused(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        with pytest.raises(ValueError):
            SA.admit_stream(spark.readStream.format("rate").load())
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("limit", [0, 1, 2, 50])
def test_maps_from_counts_equal_maps_from_events(spark, limit):
    rng = random.Random(limit)
    rows = [(f"c{rng.randrange(3)}", rng.choice([rng.randrange(-10**8, 10**8), 5, 31_000_000]), i, limit) for i in range(300)]
    slotted = bucket._slotted(spark.createDataFrame(rows, "_k string, _us long, event_id long, _lim int"), "_us", True)
    want = bucket._maps(bucket._chunked(slotted, "_us", ("event_id",), True), "_us")
    got = bucket._steady_maps(slotted, "_us")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_experiment_counts_each_key_once_and_reads_the_fold_once(spark):
    """Identities that join to one key ('a:b', 'c' and 'a', 'b:c') are one key; written and lazy events agree."""
    rows = [(i, at(i * 10**9), i % 5, ("click", "view")[i % 2], float(i), f'{{"k": {i % 4}}}') for i in range(80)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    e = P.mode_experiment(table)
    lazy = e.decided.select("event_id", "copy_no", "experiment_mode", "admitted", "tokens", "dedup_key").collect()
    written = e.events.select("event_id", "copy_no", "experiment_mode", "admitted", "tokens", "dedup_key").collect()
    assert sorted(map(str, lazy)) == sorted(map(str, written)) and len(lazy) == 4 * (16 * 20 + 16 * 3 + 48)
    want = e.events.filter("admitted").groupBy(F.col("source_topic").alias("use_case_topic"), "client_id").agg(
        F.count("*").alias("raw_events"), F.count_distinct("dedup_key").alias("unique_events"))
    assert sorted(e.metrics.select(*want.columns).collect()) == sorted(want.collect())
    ev = spark.createDataFrame([("none", "a", "b:c", "d", True), ("none", "a:b", "c", "d", True), ("none", "a", "b", "c:d", False)],
                               "experiment_mode string, client_id string, event_type string, entity_id string, admitted boolean")
    odd = P.ModeExperiment(ev.limit(0), ev.withColumn("client_id", F.lit("a")), e.baseline)
    assert sorted((r._n, r._a) for r in odd.counts.collect()) == [(1, 1), (2, 1)]


def test_the_bucket_after_twin_rows_is_that_after_both(spark):
    rows = [("radar", "c", 5, 1, 0, t, 60) for t in (58.0, 59.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "experiment_mode string, client_id string, us long, event_id long, copy_no int, tokens double, limit_per_minute int").coalesce(1)
        assert P.bucket_state(df).first().tokens == 58.0


def test_admission_streams_run_in_a_session_that_names_no_state_store(spark, tmp_path):
    from replaygate.plans.queries import QUERIES
    rows = [(i, at(i * 200_000_000_000), i % 3, ("click", "view")[i % 2], float(i), f'{{"k": {i % 5}}}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get(SA.PROVIDER)
    try:
        spark.conf.unset(SA.PROVIDER)
        got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("stream_admission", "stream_live_limits", "stream_from_stored_buckets")}
        assert spark.conf.get(SA.PROVIDER, None) is None
    finally:
        spark.conf.set(SA.PROVIDER, before)
    assert sorted(got["stream_admission"]) == sorted(QUERIES["token_bucket"](spark, str(tmp_path)).collect())
    assert sorted(r.event_id for r in got["stream_live_limits"]) == list(range(60))
    assert sorted(r.event_id for r in got["stream_from_stored_buckets"]) == list(range(30, 60))


def test_one_bad_upload_rejects_itself_only(spark):
    ev = [(u, 10 * u + i, "c", "t", None if (u, i) == (2, 1) else "e", i) for u in (1, 2, 3, 4) for i in range(3)]
    events = spark.createDataFrame(ev, "upload_id long, event_id long, client_id string, event_type string, entity_id string, us long")
    asked = spark.createDataFrame([(1, "One", None), (2, "Two", "radar"), (3, "Three", "what"), (4, None, "none"), (5, "Five", "none")], "upload_id long, use_case_name string, experiment_mode string")
    limits = spark.createDataFrame([("c", 50)], "client_id string, limit_per_minute int")
    stored = spark.createDataFrame([("radar", "c", 2.5, 0)], "experiment_mode string, client_id string, tokens double, last_refill long")
    responses, decided = requests.ingest_requests(asked, events, limits, initial=stored)
    got = {r.upload_id: r for r in responses.collect()}
    assert [got[i].status for i in range(1, 6)] == ["ingested", "invalid_events", "invalid_experiment_mode", "missing_use_case_name", "ingested"]
    assert (got[1].accepted, got[1].rejected, got[1].total_events, got[1].topic) == (2, 1, 3, "usecase_one")
    info = got[1].rejections[0].rate_info
    assert (info.mode, info.strategy, info.tokens_remaining, info.limit_per_minute, info.bucket_capacity) == ("radar", "radar_adaptive_token_bucket", 0.5, 50, 50)
    assert (got[2].accepted, got[2].invalid_events, got[2].rejections) == (0, 1, []) and (got[5].total_events, got[5].accepted) == (0, 0)
    assert decided.count() == 3 and os.path.basename(got[1].topic) == "usecase_one"


@pytest.mark.parametrize("seed", [0, 1])
def test_rows_with_copies_decide_as_their_copies_one_by_one(spark, seed):
    """Rows at one time, twins in time and order, and a client without a name among them."""
    rng, rows = random.Random(seed), []
    for e, c, t, limit in random_events(seed):
        if c is None or int(c[1:]) % 3:
            rows += [(e // 2 if rng.random() < 0.3 else e, c, t, limit, 20 if c in (None, "c1", "c7") else 3 if c == "c2" else 1)] * (2 if rng.random() < 0.1 else 1)
    df = spark.createDataFrame(rows, "event_id long, client_id string, us long, _lim int, copies int").withColumn("_us", F.col("us"))
    one = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    want = bucket.fold_serially(one, ["client_id"], "_us", ("event_id", "copy_no"))
    got = bucket.copied(bucket.fold_copied(df, ["client_id"], "_us", ("event_id",), "copies"), "copies").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    per_client = lambda rows: {r.client_id: r.n for r in rows.collect()}
    folded = bucket.fold_copied(df, ["client_id"], "_us", ("event_id",), "copies")
    assert per_client(folded.groupBy("client_id").agg(F.sum(bucket.copies_admitted("copies")).alias("n"))) == per_client(want.groupBy("client_id").agg(F.count_if("admitted").alias("n")))

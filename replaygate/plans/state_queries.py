"""Registered queries of what is kept between batches: live limits, buckets, stores, uploads as
requests, and streams that run over several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission, limits, metrics, requests
from ..schema import Policy
from ..session import scratch_path
from ..sources import io as IO
from ..sources import store as ST
from ..sources.tables import load_ge, load_ge_replay
from ..streaming import admission as SA
from ..streaming import dedup as SD
from ..streaming import live as SL
from ..streaming import pipeline as SP
from . import pipelines as P
from . import sql as S
from .queries import _BDEC, _batch_decisions, ntz, register

SLICES = 4

# The time axis in four slices, each one micro-batch.
_SLICED = f"""{S.GE},
axis AS (SELECT min(us) AS lo, (max(us) - min(us)) // {SLICES} + 1 AS width FROM ge),
cut AS (SELECT ge.*, (ge.us - axis.lo) // axis.width AS slice FROM ge, axis)"""


def _sliced(ge: DataFrame) -> DataFrame:
    lo = ge.select(F.min("us")).scalar()
    width = ge.select(F.floor((F.max("us") - F.min("us")) / SLICES) + 1).scalar()
    return ge.withColumn("slice", F.floor((F.col("us") - lo) / width).cast("int"))


def _write_slice(sliced: DataFrame, i: int, path: str) -> None:
    sliced.filter(F.col("slice") == i).drop("slice").write.mode("append").parquet(path)


# --------------------------------------------------------------------------- live loop

_LIVE_SQL = f"""WITH RECURSIVE {_SLICED},
m AS (SELECT slice, source_topic, client_id, {S.ratio('count(*) - count(DISTINCT dedup_key)', 'count(*)')} AS r
      FROM cut GROUP BY slice, source_topic, client_id),
made AS (SELECT slice, max(us) + 1 AS decided_us FROM cut GROUP BY slice),
dec AS (SELECT m.client_id, made.decided_us, arg_max({S.tier('r')}, source_topic) AS l
        FROM m JOIN made ON m.slice = made.slice GROUP BY m.client_id, made.decided_us),
ev AS (SELECT e.event_id, e.client_id, e.us,
              CASE WHEN e.user_id % 4 = 3 THEN 'none' WHEN e.user_id % 4 = 2 THEN 'static' ELSE 'radar' END AS mode,
              CASE WHEN e.user_id % 4 = 2 THEN 1000 ELSE greatest(50, coalesce(d.l, 10000)) END AS limit_per_minute
       FROM cut e ASOF LEFT JOIN dec d ON e.client_id = d.client_id AND e.us >= d.decided_us),
{S.token_bucket("(SELECT * FROM ev WHERE mode <> 'none')", 'limit_per_minute', extra='mode')}"""


@register("stream_live_limits", _LIVE_SQL + """
SELECT event_id, k AS client_id, mode, lim AS limit_per_minute, admitted, tok AS tokens FROM tb
UNION ALL SELECT event_id, client_id, mode, 10000, true, NULL FROM ev WHERE mode = 'none'""")
def q_stream_live_limits(spark, sf_dir):
    """The live loop (C2 into T8) over four micro-batches in three modes: each slice is
    measured and decided, then admitted; decisions of a slice rule the events after it."""
    sliced = _sliced(load_ge(spark, sf_dir).select("event_id", "user_id", "client_id", "source_topic", "dedup_key", "us"))
    src, told, out, c1, c2 = (scratch_path(spark, n) for n in ("live-src", "decisions", "live-out", "ckpt", "ckpt"))
    schema = sliced.drop("slice").schema
    mode = F.when(F.col("user_id") % 4 == 3, "none").when(F.col("user_id") % 4 == 2, "static").otherwise("radar")
    now = {"availableNow": True}
    for i in range(SLICES):
        _write_slice(sliced, i, src)
        SL.start_deciding(spark.readStream.schema(schema).parquet(src), told, c1, now).awaitTermination()
        events = spark.readStream.schema(schema).parquet(src).select("event_id", "client_id", "us", mode.alias("mode"))
        with SA.state_in_rocksdb(spark):
            admitting = SL.start_admitting(events, SL.read_decisions(spark, told), out, c2, now, mode_col="mode")
        admitting.awaitTermination()
    got = spark.read.parquet(out)
    limit = F.when(F.col("mode") == "none", F.lit(10000)).otherwise(F.col("limit_per_minute"))
    return got.select("event_id", "client_id", "mode", limit.alias("limit_per_minute"), "admitted", "tokens")


# --------------------------------------------------------------------------- buckets between uploads

_UPLOADS_SQL = f"""WITH RECURSIVE {_SLICED},
ev AS (SELECT event_id, client_id, us, slice, m.mode AS mode, m.mode || '|' || client_id AS bk, m.l AS limit_per_minute
       FROM cut, (VALUES ('static', 1000), ('radar', 60)) m(mode, l) WHERE m.mode = 'radar' OR user_id % 2 = 0),
{S.token_bucket('ev', 'limit_per_minute', key='bk', extra='client_id, mode, slice')}"""


def _uploads_in_sequence(spark, sf_dir):
    """(decided events, bucket store): four uploads, each going on from the stored buckets."""
    sliced = _sliced(load_ge(spark, sf_dir).select("event_id", "user_id", "client_id", "us"))
    modes = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("static"), F.lit("radar"))).otherwise(F.array(F.lit("radar")))
    ev = sliced.withColumn("experiment_mode", F.explode(modes))
    ev = ev.withColumn("limit_per_minute", F.when(F.col("experiment_mode") == "static", 1000).otherwise(60))
    store, out = ST.bucket_store(spark, scratch_path(spark, "buckets")), scratch_path(spark, "uploads")
    for i in range(SLICES):
        upload = ev.filter(F.col("slice") == i)
        done = admission.token_bucket(upload, "limit_per_minute", mode="experiment_mode", steady=True, initial=store.read())
        done.write.mode("append").parquet(out)
        mine = spark.read.parquet(out).filter(F.col("slice") == i)
        store.upsert(P.bucket_state(mine, order=("event_id",)))
    return spark.read.parquet(out), store


@register("uploads_in_sequence", _UPLOADS_SQL + """
SELECT event_id, client_id, mode AS experiment_mode, admitted, tok AS tokens FROM tb""")
def q_uploads_in_sequence(spark, sf_dir):
    """C6 into T8: four uploads one after the other, buckets kept in the store, decide as one fold does."""
    return _uploads_in_sequence(spark, sf_dir)[0].select("event_id", "client_id", "experiment_mode", "admitted", "tokens")


@register("bucket_store", _UPLOADS_SQL + """
SELECT mode AS experiment_mode, client_id, arg_max(tok, rn) AS tokens, max(us) AS last_refill, min(lim) AS limit_per_minute, greatest(1, min(lim)) AS bucket_capacity
FROM tb GROUP BY mode, client_id""")
def q_bucket_store(spark, sf_dir):
    """The stored bucket of each (mode, client) after four uploads."""
    return _uploads_in_sequence(spark, sf_dir)[1].read()


@register("stream_from_stored_buckets", f"""WITH RECURSIVE {S.GE}, {S.token_bucket('ge', '60')},
axis AS (SELECT (min(us) + max(us)) // 2 AS half FROM ge)
SELECT event_id, k AS client_id, admitted, tok AS tokens FROM tb, axis WHERE us > half""")
def q_stream_from_stored_buckets(spark, sf_dir):
    """T8 on a stream that starts from buckets a batch left behind (initial state): the second half of the time axis."""
    ge = load_ge(spark, sf_dir).select("event_id", "client_id", "us")
    half = ge.select(F.floor((F.min("us") + F.max("us")) / 2)).scalar()
    ev = ge.withColumn("limit_per_minute", F.lit(60)).withColumn("late", F.col("us") > half)
    before = admission.token_bucket(ev.filter("not late").withColumn("experiment_mode", F.lit(SA.NO_MODE)), 60)
    store = ST.bucket_store(spark, scratch_path(spark, "buckets"))
    store.upsert(P.bucket_state(before, order=("event_id",)))
    src, out, ck = scratch_path(spark, "second-half"), scratch_path(spark, "admitted"), scratch_path(spark, "ckpt")
    ev.filter("late").drop("late").write.parquet(src)
    events = spark.readStream.schema("event_id long, client_id string, us long, limit_per_minute int").parquet(src)
    with SA.state_in_rocksdb(spark):
        q = (SA.admit_stream(events, initial=store.read()).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "client_id", "admitted", "tokens")


# --------------------------------------------------------------------------- uploads as requests

_MODES = ["NULL", "'radar'", "' STATIC '", "'none'", "'bogus'"]

# 40 uploads of the replayed events: modes by upload, a missing name, an upload with an
# invalid event in it, and one without events.
_REQUEST_SQL = f"""WITH RECURSIVE {S.ge_replay('ge', 'usecase_replay')}, {S.exact_metrics('ge')},
lim AS (SELECT client_id, max_by({S.tier('duplicate_ratio')}, use_case_topic) AS l FROM em GROUP BY client_id),
req AS (SELECT i AS upload_id, CASE WHEN i = 11 THEN NULL ELSE 'Upload #' || i || '!' END AS use_case_name, [{', '.join(_MODES)}][1 + i % 5] AS raw FROM range(41) t(i)),
up AS (SELECT *, event_id % 40 AS upload_id, CASE WHEN event_id % 40 = 7 AND user_id % 5 = 0 THEN NULL ELSE entity_id END AS entity FROM ge),
n AS (SELECT upload_id, count(*) AS total_events, count(*) FILTER (WHERE entity IS NULL) AS invalid_events FROM up GROUP BY upload_id),
jud AS (
  SELECT req.upload_id, use_case_name, CASE WHEN raw = 'bogus' THEN NULL ELSE lower(trim(coalesce(raw, 'radar'))) END AS experiment_mode,
         coalesce(total_events, 0) AS total_events, coalesce(invalid_events, 0) AS invalid_events
  FROM req LEFT JOIN n ON n.upload_id = req.upload_id
), verdict AS (
  SELECT *, CASE WHEN use_case_name IS NULL THEN 'missing_use_case_name' WHEN experiment_mode IS NULL THEN 'invalid_experiment_mode'
                 WHEN invalid_events > 0 THEN 'invalid_events' ELSE 'ingested' END AS status, 'usecase_upload_' || upload_id AS topic FROM jud
), ev AS (
  SELECT up.event_id, up.copy_no, up.us, up.client_id, up.entity, v.upload_id, v.experiment_mode AS mode, v.experiment_mode || '|' || up.client_id AS bk,
         CASE WHEN v.experiment_mode = 'static' THEN 1000 ELSE greatest(50, coalesce(lim.l, 10000)) END AS limit_per_minute
  FROM up JOIN verdict v ON v.upload_id = up.upload_id AND v.status = 'ingested' LEFT JOIN lim ON lim.client_id = up.client_id
), {S.token_bucket("(SELECT * FROM ev WHERE mode <> 'none')", 'limit_per_minute', key='bk', order='us, event_id, copy_no', extra='client_id, mode, upload_id, entity, copy_no')},
cnt AS (SELECT upload_id, count(*) FILTER (WHERE admitted) AS a, count(*) FILTER (WHERE NOT admitted) AS b FROM
        (SELECT upload_id, admitted FROM tb UNION ALL SELECT upload_id, true FROM ev WHERE mode = 'none') GROUP BY upload_id),
rej AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY us, event_id, copy_no) AS n FROM tb WHERE NOT admitted)"""


def _requests(spark, sf_dir):
    ge = load_ge_replay(spark, sf_dir, "usecase_replay")
    cur = P.decide(metrics.exact_metrics(ge)).current
    upload = F.col("event_id") % 40
    broken = (upload == 7) & (F.col("user_id") % 5 == 0)
    events = ge.select(upload.alias("upload_id"), "event_id", "copy_no", "client_id", "event_type", F.when(~broken, F.col("entity_id")).alias("entity_id"), "us")
    modes = F.array(*[F.expr(m).cast("string") for m in _MODES])
    asked = spark.range(41).select(F.col("id").alias("upload_id"), F.when(F.col("id") != 11, F.concat(F.lit("Upload #"), "id", F.lit("!"))).alias("use_case_name"),
                                   F.get(modes, (F.col("id") % 5).cast("int")).alias("experiment_mode"))
    return requests.ingest_requests(asked, events, cur, order=("event_id", "copy_no"))


@register("upload_responses", _REQUEST_SQL + """
SELECT v.upload_id, status, use_case_name, CASE WHEN use_case_name IS NOT NULL THEN topic END AS topic, experiment_mode,
       CASE WHEN status <> 'ingested' THEN NULL WHEN experiment_mode = 'none' THEN 'bypass' WHEN experiment_mode = 'static' THEN 'static_token_bucket'
            ELSE 'radar_adaptive_token_bucket' END AS protection_strategy,
       total_events, coalesce(a, 0) AS accepted, coalesce(b, 0) AS rejected, invalid_events, least(coalesce(b, 0), 20) AS listed
FROM verdict v LEFT JOIN cnt ON cnt.upload_id = v.upload_id""")
def q_upload_responses(spark, sf_dir):
    """A response row per upload: verdict, topic, mode, counts."""
    return _requests(spark, sf_dir)[0].withColumn("listed", F.size("rejections").cast("long")).drop("rejections")


@register("upload_rejections", _REQUEST_SQL + """
SELECT upload_id, CAST(n AS INTEGER) AS position, client_id, entity AS entity_id, mode, CASE WHEN mode = 'static' THEN 'static_token_bucket' ELSE 'radar_adaptive_token_bucket' END AS strategy,
       round_even(tok, 2) AS tokens_remaining, lim AS limit_per_minute, greatest(1, lim) AS bucket_capacity
FROM rej WHERE n <= 20""")
def q_upload_rejections(spark, sf_dir):
    """The rejections that the responses list, with their rate info."""
    r = _requests(spark, sf_dir)[0].select("upload_id", F.posexplode("rejections").alias("position", "r"))
    return r.select("upload_id", (F.col("position") + 1).alias("position"), "r.client_id", "r.entity_id", "r.rate_info.*")


# --------------------------------------------------------------------------- stores

@register("limits_upsert", f"""WITH {_BDEC}
SELECT client_id, CAST(limit_per_minute AS INTEGER) AS limit_per_minute, use_case_topic, duplicate_ratio, decided_at, valid_until FROM cur""")
def q_limits_upsert(spark, sf_dir):
    """S10 as a keyed store: the decisions of odd batches, then those of all, leave one current row per client."""
    store = ST.limit_store(spark, scratch_path(spark, "limits"))
    decided = _batch_decisions(spark, sf_dir).withColumnRenamed("new_limit_per_minute", "limit_per_minute")
    store.upsert(decided.filter(F.second("decided_at") % 2 == 1))
    store.upsert(decided)
    return store.read().select("client_id", "limit_per_minute", "use_case_topic", "duplicate_ratio", ntz("decided_at"), ntz("valid_until"))


@register("metrics_by_date", f"""WITH {S.GE}, {S.BATCH_METRICS},
cut AS (SELECT min(batch_time) + (max(batch_time) - min(batch_time)) / 2 AS t FROM bt)
SELECT batch_id, use_case_topic, client_id, raw_events, unique_events FROM bm, cut
WHERE batch_time >= date_trunc('day', t)""")
def q_metrics_by_date(spark, sf_dir):
    """Every batch written twice into (date, batch) partitions; the later half read back by date."""
    path = scratch_path(spark, "metrics-by-date")
    m = metrics.batch_metrics(load_ge(spark, sf_dir))
    IO.write_metrics_by_date(m, path)
    IO.write_metrics_by_date(m, path)
    span = spark.read.parquet(path).select(F.date_trunc("day", F.timestamp_micros(F.floor((F.unix_micros(F.min("batch_time")) + F.unix_micros(F.max("batch_time"))) / 2)))).first()[0]
    return IO.read_metrics_by_date(spark, path, since=span).select("batch_id", "use_case_topic", "client_id", "raw_events", "unique_events")


@register("limits_asof_live", f"""WITH {_SLICED}, {S.BATCH_METRICS},
dec AS (SELECT client_id, batch_time AS decided_at, arg_max({S.tier('duplicate_ratio')}, use_case_topic) AS l,
               batch_time + INTERVAL 2 DAY AS valid_until FROM bm GROUP BY client_id, batch_time)
SELECT e.event_id, e.client_id, CAST(CASE WHEN e.event_ts < d.valid_until THEN greatest(50, d.l) ELSE 10000 END AS INTEGER) AS limit_per_minute,
       CASE WHEN e.event_ts < d.valid_until THEN d.decided_at END AS decided_at
FROM ge e ASOF LEFT JOIN dec d ON e.client_id = d.client_id AND e.event_ts >= d.decided_at""")
def q_limits_asof_live(spark, sf_dir):
    """J2 where most events find a decision and some decisions have expired: limits valid for two days."""
    ge = load_ge(spark, sf_dir)
    decided = limits.decide_limits(metrics.batch_metrics(ge), F.col("batch_time"), Policy(limit_ttl_s=2 * 86400))
    return limits.with_limits_asof(ge.select("event_id", "client_id", "event_ts"), decided).select("event_id", "client_id", "limit_per_minute", ntz("decided_at"))


@register("sketched_metrics", f"""WITH {S.GE}, {S.exact_metrics('ge')},
t AS (SELECT use_case_topic, CAST(sum(raw_events) AS BIGINT) AS raw_events FROM em GROUP BY use_case_topic)
SELECT use_case_topic, client_id, raw_events, true AS within_bound FROM em
UNION ALL SELECT use_case_topic, NULL, raw_events, true FROM t""")
def q_sketched_metrics(spark, sf_dir):
    """A3's sketch form: unique keys of all batches from per-batch sketches, by (topic, client) and by
    topic, within four standard errors of the exact counts."""
    ge = load_ge(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    metrics.sketched_metrics(ge).write.parquet(path)
    parts = spark.read.parquet(path)
    exact = ge.select("source_topic", "client_id", "dedup_key").distinct()
    bound = 4 * 0.83 / 2 ** (metrics.SKETCH_BITS / 2)
    by_client = exact.groupBy(F.col("source_topic").alias("use_case_topic"), "client_id").agg(F.count("*").alias("n"))
    by_topic = by_client.groupBy("use_case_topic").agg(F.sum("n").alias("n")).withColumn("client_id", F.lit(None).cast("string"))
    got = metrics.merged_metrics(parts).unionByName(metrics.merged_metrics(parts, by=("use_case_topic",)).withColumn("client_id", F.lit(None).cast("string")))
    known = by_client.unionByName(by_topic).withColumnsRenamed({"use_case_topic": "t", "client_id": "c"})
    joined = got.join(known, (F.col("use_case_topic") == F.col("t")) & F.col("client_id").eqNullSafe(F.col("c")))
    return joined.select("use_case_topic", "client_id", "raw_events", (F.abs(F.col("unique_events") - F.col("n")) <= F.lit(bound) * F.col("n") + 0.5).alias("within_bound"))


# --------------------------------------------------------------------------- streams over several micro-batches

@register("stream_metrics_batches", f"""WITH {_SLICED}
SELECT slice AS batch_id, source_topic AS use_case_topic, client_id, CAST(count(*) AS BIGINT) AS raw_events, CAST(count(DISTINCT dedup_key) AS BIGINT) AS unique_events,
       CAST(count(*) - count(DISTINCT dedup_key) AS BIGINT) AS duplicate_events, {S.ratio('count(*) - count(DISTINCT dedup_key)', 'count(*)')} AS duplicate_ratio
FROM cut GROUP BY slice, source_topic, client_id""")
def q_stream_metrics_batches(spark, sf_dir):
    """Four micro-batches, the query restarted from its checkpoint for each; all metric columns of every batch."""
    sliced = _sliced(load_ge(spark, sf_dir).select("client_id", "source_topic", "dedup_key", "us"))
    src, out, ck = scratch_path(spark, "metric-src"), scratch_path(spark, "metrics"), scratch_path(spark, "ckpt")
    for i in range(SLICES):
        _write_slice(sliced, i, src)
        SP.write_metrics(spark.readStream.schema(sliced.drop("slice").schema).parquet(src), out, ck, trigger={"availableNow": True}).awaitTermination()
    return IO.read_metrics(spark, out).select("batch_id", "use_case_topic", "client_id", "raw_events", "unique_events", "duplicate_events", "duplicate_ratio")


# Event time of slice i: i hours after a fixed start, so a key comes back past the watermark's horizon.
_HOURS = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(slice AS INTEGER)"


@register("stream_dedup_horizon", f"""WITH {_SLICED},
seen AS (SELECT dedup_key, bool_or(slice = 0) AS p0, bool_or(slice = 1) AS p1, bool_or(slice = 2) AS p2, bool_or(slice = 3) AS p3 FROM cut GROUP BY dedup_key),
a1 AS (SELECT *, p1 AND NOT p0 AS n1 FROM seen), a2 AS (SELECT *, p2 AND NOT n1 AS n2 FROM a1), a3 AS (SELECT *, p3 AND NOT n2 AS n3 FROM a2)
SELECT dedup_key, {_HOURS} AS event_ts
FROM (SELECT dedup_key, unnest(list_filter([0, 1, 2, 3], lambda i: [p0, n1, n2, n3][i + 1])) AS slice FROM a3)""")
def q_stream_dedup_horizon(spark, sf_dir):
    """T3 over four micro-batches an hour apart. A key is dropped while its state is held; the watermark
    passes a slice's horizon with the next slice, so a key comes through again from the second slice
    after the one that let it through, and once within a slice."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 3600 * F.col("slice"))
    sliced = _sliced(load_ge(spark, sf_dir).select("dedup_key", "us")).select("dedup_key", at.alias("event_ts"), "slice")
    src, out, ck = scratch_path(spark, "dedup-src"), scratch_path(spark, "clean"), scratch_path(spark, "ckpt")
    for i in range(SLICES):
        _write_slice(sliced, i, src)
        stream = SD.dedup_stream_bounded(spark.readStream.schema("dedup_key string, event_ts timestamp").parquet(src))
        SP.write_clean_events(stream, out, ck, trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select("dedup_key", ntz("event_ts"))


@register("stream_counters", f"""WITH {_SLICED}
SELECT client_id, source_topic AS topic, CAST(count(*) FILTER (WHERE event_id % 3 > 0) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS blocked FROM cut GROUP BY client_id, source_topic""")
def q_stream_counters(spark, sf_dir):
    """Counters in update mode over four micro-batches; the last update of each client and topic."""
    sliced = _sliced(load_ge(spark, sf_dir).select("client_id", "source_topic", (F.col("event_id") % 3 > 0).alias("admitted"), "us"))
    src, out, ck = scratch_path(spark, "counter-src"), scratch_path(spark, "counters"), scratch_path(spark, "ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/update={batch_id}")

    for i in range(SLICES):
        _write_slice(sliced, i, src)
        counted = SP.running_counters(spark.readStream.schema(sliced.drop("slice").schema).parquet(src))
        counted.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("client_id", "topic").agg(F.max_by(F.struct("accepted", "blocked"), "batch").alias("v"))
    return last.select("client_id", "topic", "v.accepted", "v.blocked")


# Admitted events in four slices an hour apart, a second apart by event id within.
@register("stream_admission_rate", f"""WITH {_SLICED},
rates AS (SELECT event_id % 3 > 0 AS admitted, epoch_us({_HOURS}) + (event_id % 60) * 1000000 AS t FROM cut),
w AS (SELECT admitted, t - t % 5000000 - j * 5000000 AS s FROM rates, (SELECT unnest(range(0, 6)) AS j)),
last AS (SELECT max(t) AS t FROM rates)
SELECT make_timestamp(s) AS window_start, make_timestamp(s + 30000000) AS window_end, CAST(count(*) FILTER (WHERE admitted) AS DOUBLE) / CAST(30 AS DOUBLE) AS accepted_per_s,
       CAST(count(*) FILTER (WHERE NOT admitted) AS DOUBLE) / CAST(30 AS DOUBLE) AS blocked_per_s
FROM w, last WHERE s + 30000000 <= last.t - 10000000 GROUP BY s""")
def q_stream_admission_rate(spark, sf_dir):
    """T12 / W4 on a stream of four micro-batches: windows are final once the watermark has passed them."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 3600 * F.col("slice") + F.col("event_id") % 60)
    sliced = _sliced(load_ge(spark, sf_dir).select("event_id", "us")).select((F.col("event_id") % 3 > 0).alias("admitted"), at.alias("event_ts"), "slice")
    src, out, ck = scratch_path(spark, "rate-src"), scratch_path(spark, "rates"), scratch_path(spark, "ckpt")
    for i in range(SLICES):
        _write_slice(sliced, i, src)
        rates = SP.admission_rate_stream(spark.readStream.schema("admitted boolean, event_ts timestamp").parquet(src))
        SP.write_clean_events(rates, out, ck, trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select(ntz("window_start"), ntz("window_end"), "accepted_per_s", "blocked_per_s")

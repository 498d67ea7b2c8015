"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every query reads the given tables (``events`` through the derived ``ge`` /
``ge_replay`` views) and runs over them whole. Output timestamps are
TIMESTAMP_NTZ (UTC wall clock) so that the engines compare without zone
conversion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, dedup, limits, metrics
from ..sources.tables import load_ge, load_ge_replay
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def ntz(col: str):
    return F.col(col).cast("timestamp_ntz").alias(col)


def _batch_metrics(spark, sf_dir) -> DataFrame:
    return metrics.batch_metrics(load_ge(spark, sf_dir))


# --------------------------------------------------------------------------- metrics

@register("exact_metrics", f"""WITH {S.GE}, {S.exact_metrics('ge')}
SELECT * FROM em""")
def q_exact_metrics(spark, sf_dir):
    """A3 over the whole event table."""
    return metrics.exact_metrics(load_ge(spark, sf_dir))


@register("exact_limits", f"""WITH {S.GE}, {S.exact_metrics('ge')}
SELECT use_case_topic, client_id, raw_events, unique_events, duplicate_events, duplicate_ratio,
       {S.tier('duplicate_ratio')} AS limit_per_minute
FROM em""")
def q_exact_limits(spark, sf_dir):
    """Flagship: P6 identity -> A3 exact metrics -> P15 tier per (topic, client)."""
    from ..functions.policy import limit_for_ratio
    m = metrics.exact_metrics(load_ge(spark, sf_dir))
    return m.withColumn("limit_per_minute", limit_for_ratio("duplicate_ratio"))


@register("dedup_keys", f"""WITH {S.GE}
SELECT event_id, source_topic, client_id, event_type, entity_id, dedup_key FROM ge""")
def q_dedup_keys(spark, sf_dir):
    """Deterministic identity of every event."""
    return load_ge(spark, sf_dir).select("event_id", "source_topic", "client_id", "event_type", "entity_id", "dedup_key")


@register("batch_metrics", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT batch_id, use_case_topic, client_id, raw_events, unique_events, duplicate_events, duplicate_ratio,
       batch_time FROM bm""")
def q_batch_metrics(spark, sf_dir):
    """A1: per micro-batch duplicate metrics."""
    return _batch_metrics(spark, sf_dir).select(
        "batch_id", "use_case_topic", "client_id", "raw_events", "unique_events", "duplicate_events",
        "duplicate_ratio", ntz("batch_time"))


_ROLLUP_SQL = """
SELECT use_case_topic, client_id, CAST(sum(raw_events) AS BIGINT) AS raw_events,
       CAST(sum(unique_events) AS BIGINT) AS unique_events, CAST(sum(duplicate_events) AS BIGINT) AS duplicate_events,
       """ + S.ratio("sum(duplicate_events)", "sum(raw_events)") + """ AS duplicate_ratio
FROM bm {where} GROUP BY use_case_topic, client_id"""


@register("client_metrics", f"""WITH {S.GE}, {S.BATCH_METRICS}
{_ROLLUP_SQL.format(where="WHERE batch_time >= (SELECT max(batch_time) FROM bm) - INTERVAL 30 MINUTE")}""")
def q_client_metrics(spark, sf_dir):
    """A2 + F1: rollup of batch metrics over the last 30 minutes of batch time."""
    return metrics.client_metrics(_batch_metrics(spark, sf_dir))


@register("client_metrics_all", f"""WITH {S.GE}, {S.BATCH_METRICS}
{_ROLLUP_SQL.format(where="")}""")
def q_client_metrics_all(spark, sf_dir):
    """A2 over every batch: sums of per-batch uniques (not additive across batches)."""
    return metrics.client_metrics(_batch_metrics(spark, sf_dir), minutes=None)


@register("topic_totals", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT coalesce(use_case_topic, 'raw_events') AS use_case_topic, CAST(sum(raw_events) AS BIGINT) AS raw_events,
       CAST(sum(unique_events) AS BIGINT) AS unique_events, CAST(sum(duplicate_events) AS BIGINT) AS duplicate_events,
       {S.ratio('sum(duplicate_events)', 'sum(raw_events)')} AS duplicate_ratio
FROM bm GROUP BY 1""")
def q_topic_totals(spark, sf_dir):
    """A4: messages, clean events and waste per topic."""
    return metrics.topic_totals(_batch_metrics(spark, sf_dir))


@register("summary", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT CAST(coalesce(sum(raw_events), 0) AS BIGINT) AS raw_events,
       CAST(coalesce(sum(unique_events), 0) AS BIGINT) AS unique_events,
       CAST(coalesce(sum(duplicate_events), 0) AS BIGINT) AS duplicate_events,
       CAST(count(DISTINCT client_id) + coalesce(max(CAST(client_id IS NULL AS INTEGER)), 0) AS BIGINT) AS clients,
       {S.ratio('coalesce(sum(duplicate_events), 0)', 'coalesce(sum(raw_events), 0)')} AS duplicate_ratio
FROM bm""")
def q_summary(spark, sf_dir):
    """A5: grand totals over all topics."""
    return metrics.summary(_batch_metrics(spark, sf_dir))


@register("metrics_rollup", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT coalesce(use_case_topic, 'raw_events') AS use_case_topic, client_id,
       CAST(grouping(coalesce(use_case_topic, 'raw_events'), client_id) AS BIGINT) AS level,
       CAST(sum(raw_events) AS BIGINT) AS raw_events, CAST(sum(unique_events) AS BIGINT) AS unique_events,
       CAST(sum(duplicate_events) AS BIGINT) AS duplicate_events,
       {S.ratio('sum(duplicate_events)', 'sum(raw_events)')} AS duplicate_ratio
FROM bm GROUP BY ROLLUP (coalesce(use_case_topic, 'raw_events'), client_id)""")
def q_metrics_rollup(spark, sf_dir):
    """(topic, client), topic and grand totals in one pass."""
    return metrics.metrics_rollup(_batch_metrics(spark, sf_dir)).withColumn("level", F.col("level").cast("long"))


def _round_sql(dup, raw, digits=2):
    scale = 10 ** digits
    q = f"(CAST({dup} AS BIGINT) * {scale}) // CAST({raw} AS BIGINT)"
    rem = f"(CAST({dup} AS BIGINT) * {scale} - {q} * CAST({raw} AS BIGINT))"
    up = f"CASE WHEN 2 * {rem} > {raw} OR (2 * {rem} = {raw} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {raw} = 0 THEN 0.0 ELSE CAST({q} + {up} AS DOUBLE) / CAST({scale} AS DOUBLE) END"


@register("topic_clients", f"""WITH {S.GE}, {S.BATCH_METRICS},
t AS (SELECT client_id, CAST(sum(raw_events) AS BIGINT) AS raw, CAST(sum(unique_events) AS BIGINT) AS "unique",
             CAST(sum(duplicate_events) AS BIGINT) AS duplicates
      FROM bm WHERE coalesce(use_case_topic, 'raw_events') = 'usecase_click' GROUP BY client_id)
SELECT client_id, raw, "unique", duplicates, {_round_sql('duplicates', 'raw')} AS dup_ratio FROM t""")
def q_topic_clients(spark, sf_dir):
    """One topic's clients, ratio to two places, by duplicates."""
    return metrics.topic_clients(_batch_metrics(spark, sf_dir), "usecase_click")


@register("client_profile", f"""WITH {S.GE}
SELECT client_id, CAST(count(*) AS BIGINT) AS records FROM ge GROUP BY client_id""")
def q_client_profile(spark, sf_dir):
    """Records per client."""
    return metrics.client_profile(load_ge(spark, sf_dir))


@register("replay_client", f"""WITH {S.GE}, {S.BATCH_METRICS}, cm AS ({_ROLLUP_SQL.format(where="")})
SELECT * FROM cm ORDER BY duplicate_ratio DESC, use_case_topic ASC NULLS FIRST, client_id ASC NULLS FIRST LIMIT 1""")
def q_replay_client(spark, sf_dir):
    """The highest-ratio client (top-1 is the feature)."""
    return metrics.replay_client(metrics.client_metrics(_batch_metrics(spark, sf_dir), minutes=None, ordered=False))


@register("latest_metrics", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT batch_id, use_case_topic, client_id, raw_events, unique_events, duplicate_events, duplicate_ratio, batch_time
FROM bm ORDER BY batch_time DESC, use_case_topic, client_id LIMIT 10""")
def q_latest_metrics(spark, sf_dir):
    """L3: the ten newest metric rows (a top-k report)."""
    return metrics.latest_metrics(_batch_metrics(spark, sf_dir), 10).select(
        "batch_id", "use_case_topic", "client_id", "raw_events", "unique_events", "duplicate_events",
        "duplicate_ratio", ntz("batch_time"))


@register("topics", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT DISTINCT coalesce(use_case_topic, 'raw_events') AS use_case_topic FROM bm""")
def q_topics(spark, sf_dir):
    """Distinct topics."""
    return metrics.topics(_batch_metrics(spark, sf_dir))


# --------------------------------------------------------------------------- dedup

_W5_SQL = f"""WITH {S.GE},
r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY event_ts ASC NULLS LAST, event_id) AS rn FROM ge)"""


@register("dedup_keep_first", _W5_SQL + """
SELECT dedup_key, event_id, source_topic, client_id, event_type, entity_id, event_ts FROM r WHERE rn = 1""")
def q_dedup_keep_first(spark, sf_dir):
    """One survivor per key, the earliest (event_ts, event_id)."""
    ge = load_ge(spark, sf_dir).select("dedup_key", "event_id", "source_topic", "client_id", "event_type",
                                       "entity_id", "event_ts")
    return dedup.dedup_keep_first(ge).select("dedup_key", "event_id", "source_topic", "client_id", "event_type",
                                             "entity_id", ntz("event_ts"))


@register("duplicate_events", _W5_SQL + """
SELECT event_id, dedup_key, client_id, source_topic FROM r WHERE rn > 1""")
def q_duplicate_events(spark, sf_dir):
    """Replay records (every non-survivor)."""
    ge = load_ge(spark, sf_dir).select("event_id", "dedup_key", "client_id", "source_topic", "event_ts")
    return dedup.duplicate_events(ge).select("event_id", "dedup_key", "client_id", "source_topic")


@register("late_events", f"""WITH {S.GE},
pb AS (SELECT batch_id, max(event_ts) AS bmax FROM ge GROUP BY batch_id),
wm AS (SELECT batch_id, max(bmax) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                        - INTERVAL 10 MINUTE AS watermark FROM pb)
SELECT ge.event_id, ge.batch_id, ge.event_ts, wm.watermark FROM ge JOIN wm ON ge.batch_id = wm.batch_id
WHERE ge.event_ts IS NOT NULL AND wm.watermark IS NOT NULL AND ge.event_ts < wm.watermark""")
def q_late_events(spark, sf_dir):
    """T4 (batch form): rows the 10-minute watermark would drop."""
    ge = load_ge(spark, sf_dir).select("event_id", "batch_id", "event_ts")
    return dedup.late_events(ge).select("event_id", "batch_id", ntz("event_ts"), ntz("watermark"))


@register("replay_records", f"""WITH {S.ge_replay('r', 'usecase_replay')},
n AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY event_ts, event_id) AS rn FROM r)
SELECT client_id, event_id, CAST(count(*) AS BIGINT) AS replays FROM n WHERE rn > 1 GROUP BY client_id, event_id""")
def q_replay_records(spark, sf_dir):
    """J9 where replays carry their original's id: replay records per client and event."""
    r = load_ge_replay(spark, sf_dir, "usecase_replay").select("event_id", "dedup_key", "client_id", "event_ts")
    return dedup.duplicate_events(r).groupBy("client_id", "event_id").agg(F.count(F.lit(1)).alias("replays"))


@register("late_events_interleaved", f"""WITH {S.GE},
b AS (SELECT event_id, event_id % 7 AS batch_id, event_ts FROM ge),
m AS (SELECT batch_id, max(max(event_ts)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             - INTERVAL 10 DAYS AS watermark FROM b GROUP BY batch_id)
SELECT event_id, batch_id, event_ts, watermark FROM b JOIN m USING (batch_id) WHERE event_ts < watermark""")
def q_late_events_interleaved(spark, sf_dir):
    """T4 (batch form) on batches that interleave in time: every later batch has rows behind the watermark."""
    ge = load_ge(spark, sf_dir).select("event_id", (F.col("event_id") % 7).alias("batch_id"), "event_ts")
    return dedup.late_events(ge, "10 days").select("event_id", "batch_id", ntz("event_ts"), ntz("watermark"))


# --------------------------------------------------------------------------- admission

@register("token_bucket", f"""WITH RECURSIVE {S.GE}, {S.token_bucket('ge', '50')}
SELECT event_id, k AS client_id, admitted, tok AS tokens FROM tb""")
def q_token_bucket(spark, sf_dir):
    """Token bucket per client at 50 events/min on the compressed time axis."""
    ge = load_ge(spark, sf_dir).select("event_id", "client_id", "us")
    return admission.token_bucket(ge, 50).select("event_id", "client_id", "admitted", "tokens")


@register("burst_admission", f"""WITH {S.GE}, {S.exact_metrics('ge')},
lim AS (SELECT client_id, max_by({S.tier('duplicate_ratio')}, use_case_topic) AS limit_per_minute
        FROM em GROUP BY client_id),
ev AS (SELECT ge.event_id, ge.client_id, ge.event_ts,
              greatest(50, coalesce(lim.limit_per_minute, 10000)) AS limit_per_minute
       FROM ge LEFT JOIN lim ON ge.client_id = lim.client_id),
r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY event_ts, event_id) AS rn FROM ev)
SELECT event_id, client_id, limit_per_minute, rn <= greatest(1, limit_per_minute) AS admitted FROM r""")
def q_burst_admission(spark, sf_dir):
    """Zero-elapsed burst through a full bucket, limits from the exact ratios."""
    ge = load_ge(spark, sf_dir)
    dec = limits.decide_limits(metrics.exact_metrics(ge))
    cur = limits.current_limits(dec)
    ev = limits.with_limits(ge.select("event_id", "client_id", "event_ts"), cur)
    return admission.admit_burst(ev, "limit_per_minute").select("event_id", "client_id", "limit_per_minute", "admitted")


@register("burst_admission_wide", f"""WITH {S.ge_replay('r', 'usecase_replay')},
n AS (SELECT 'c' || (user_id % 2) AS client_id, event_id, copy_no,
             row_number() OVER (PARTITION BY user_id % 2 ORDER BY us, event_id, copy_no) AS rn FROM r)
SELECT client_id, event_id, copy_no, rn <= 15000 AS admitted FROM n""")
def q_burst_admission_wide(spark, sf_dir):
    """W1 with a limit above every tier, on two clients that hold half of the events each."""
    r = load_ge_replay(spark, sf_dir, "usecase_replay")
    r = r.select(F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("client_id"), "event_id", "copy_no", "us")
    out = admission.admit_burst(r, 15000, order=("us", "event_id", "copy_no"), block_s=1)
    return out.select("client_id", "event_id", "copy_no", "admitted")


# --------------------------------------------------------------------------- closed loop (C4) and its parts

from . import pipelines as P  # noqa: E402
from ..operators import joins, windows  # noqa: E402
from ..sources.tables import read_table  # noqa: E402

_C4_SQL = f"""WITH RECURSIVE {S.ge_replay('r1', 'usecase_round_1')}, {S.ge_replay('r2', 'usecase_round_2')},
{S.exact_metrics('r1', 'm1')},
lim AS (SELECT client_id, max_by({S.tier('duplicate_ratio')}, use_case_topic) AS l FROM m1 GROUP BY client_id),
r2l AS (SELECT r2.*, greatest(50, coalesce(lim.l, 10000)) AS limit_per_minute
        FROM r2 LEFT JOIN lim ON r2.client_id = lim.client_id),
{S.token_bucket('r2l', 'limit_per_minute', order='us, event_id, copy_no', extra='source_topic, dedup_key, copy_no')},
acc AS (SELECT k AS client_id, source_topic, dedup_key FROM tb WHERE admitted),
{S.exact_metrics('acc', 'm2')}"""

_J5_SELECT = """
both_m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
cmp AS (
  SELECT CAST(coalesce(sum(CASE WHEN use_case_topic = '{b}' THEN raw_events END), 0) AS BIGINT) AS baseline_raw,
         CAST(coalesce(sum(CASE WHEN use_case_topic = '{b}' THEN unique_events END), 0) AS BIGINT) AS baseline_unique,
         CAST(coalesce(sum(CASE WHEN use_case_topic = '{b}' THEN duplicate_events END), 0) AS BIGINT) AS baseline_duplicates,
         CAST(coalesce(sum(CASE WHEN use_case_topic = '{p}' THEN raw_events END), 0) AS BIGINT) AS protected_raw,
         CAST(coalesce(sum(CASE WHEN use_case_topic = '{p}' THEN unique_events END), 0) AS BIGINT) AS protected_unique,
         CAST(coalesce(sum(CASE WHEN use_case_topic = '{p}' THEN duplicate_events END), 0) AS BIGINT) AS protected_duplicates,
         count(*) FILTER (WHERE use_case_topic = '{b}') AS nb, count(*) FILTER (WHERE use_case_topic = '{p}') AS np
  FROM both_m WHERE use_case_topic IN ('{b}', '{p}')
)
SELECT '{b}' AS baseline_topic, '{p}' AS protected_topic, baseline_raw, baseline_unique, baseline_duplicates,
       protected_raw, protected_unique, protected_duplicates,
       CAST(greatest(0, baseline_raw - protected_raw) AS BIGINT) AS load_reduced,
       CAST(greatest(0, baseline_duplicates - protected_duplicates) AS BIGINT) AS waste_reduced,
       CASE WHEN baseline_raw = 0 THEN 0.0 ELSE 100.0 * CAST(greatest(0, baseline_raw - protected_raw) AS DOUBLE) / CAST(baseline_raw AS DOUBLE) END AS load_reduction_pct,
       CASE WHEN baseline_duplicates = 0 THEN 0.0 ELSE 100.0 * CAST(greatest(0, baseline_duplicates - protected_duplicates) AS DOUBLE) / CAST(baseline_duplicates AS DOUBLE) END AS waste_reduction_pct,
       CASE WHEN baseline_raw = 0 THEN 0.0 ELSE 100.0 * CAST(protected_raw AS DOUBLE) / CAST(baseline_raw AS DOUBLE) END AS protected_load_pct
FROM cmp WHERE nb > 0 AND np > 0"""


def _loop(spark, sf_dir):
    return P.closed_loop(read_table(spark, sf_dir, "events"))


def _round1_decisions(spark, sf_dir):
    return P.round1_decisions(read_table(spark, sf_dir, "events")).decisions


@register("closed_loop", _C4_SQL + "," + _J5_SELECT.format(b="usecase_round_1", p="usecase_round_2"))
def q_closed_loop(spark, sf_dir):
    """C4: round 1 open, limits from exact ratios, round 2 through the adaptive bucket, J5 comparison."""
    return _loop(spark, sf_dir).comparison


@register("closed_loop_limits", f"""WITH {S.ge_replay('r1', 'usecase_round_1')}, {S.exact_metrics('r1', 'm1')}
SELECT client_id, use_case_topic, duplicate_ratio, {S.tier('duplicate_ratio')} AS new_limit_per_minute FROM m1""")
def q_closed_loop_limits(spark, sf_dir):
    """C2 on round 1: one decision per client (tiers from exact ratios)."""
    return _round1_decisions(spark, sf_dir).select("client_id", "use_case_topic", "duplicate_ratio", "new_limit_per_minute")


@register("closed_loop_admission", _C4_SQL + """
SELECT k AS client_id, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS admitted,
       CAST(count(*) FILTER (WHERE NOT admitted) AS BIGINT) AS blocked, min(lim) AS limit_per_minute
FROM tb GROUP BY k""")
def q_closed_loop_admission(spark, sf_dir):
    """T8 with per-client adaptive limits (J1): admitted and blocked per client in round 2."""
    r2 = _loop(spark, sf_dir).round2
    return r2.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("admitted").alias("admitted"),
        F.count_if(~F.col("admitted")).alias("blocked"), F.min("limit_per_minute").alias("limit_per_minute"))


@register("blocked_events", _C4_SQL + """
SELECT event_id, CAST(copy_no AS INTEGER) AS copy_no, k AS client_id, tok AS tokens FROM tb WHERE NOT admitted""")
def q_blocked_events(spark, sf_dir):
    """the blocked side of the round-2 split (with the bucket level at the time)."""
    _, blocked = admission.split_admitted(_loop(spark, sf_dir).round2)
    return blocked.select("event_id", "copy_no", "client_id", "tokens")


@register("throttled_clients", f"""WITH {S.ge_replay('r1', 'usecase_round_1')}, {S.exact_metrics('r1', 'm1')},
d AS (SELECT client_id, use_case_topic, duplicate_ratio, {S.tier('duplicate_ratio')} AS new_limit_per_minute FROM m1)
SELECT client_id, use_case_topic, new_limit_per_minute FROM d WHERE new_limit_per_minute < 10000""")
def q_throttled_clients(spark, sf_dir):
    """decisions below the default limit."""
    return limits.throttled(_round1_decisions(spark, sf_dir)).select(
        "client_id", "use_case_topic", "new_limit_per_minute")


@register("throttle_count", f"""WITH {S.ge_replay('r1', 'usecase_round_1')}, {S.exact_metrics('r1', 'm1')}
SELECT use_case_topic, CAST(count(*) FILTER (WHERE {S.tier('duplicate_ratio')} < 10000) AS BIGINT) AS throttled_decisions
FROM m1 GROUP BY use_case_topic""")
def q_throttle_count(spark, sf_dir):
    """Throttling decisions per topic."""
    return limits.throttle_count(_round1_decisions(spark, sf_dir), by=("use_case_topic",))


@register("guess_comparison", _C4_SQL + """,
t AS (SELECT use_case_topic AS t FROM m1 UNION ALL SELECT use_case_topic FROM m2),
g AS (SELECT min(t) FILTER (WHERE regexp_matches(t, 'round_1|baseline', 'i')) AS b,
             min(t) FILTER (WHERE regexp_matches(t, 'round_2|protected', 'i')) AS p,
             min(t) AS first FROM t)
SELECT coalesce(b, first) AS baseline_topic,
       coalesce(p, CASE WHEN coalesce(b, first) = first THEN (SELECT min(t) FROM t WHERE t > (SELECT first FROM g))
                        ELSE first END) AS protected_topic
FROM g""")
def q_guess_comparison(spark, sf_dir):
    """baseline and protected topics guessed from the topic names."""
    lp = _loop(spark, sf_dir)
    return joins.guess_comparison(lp.metrics1.unionByName(lp.metrics2))


@register("evidence_report", _C4_SQL + """,
allm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
thr AS (SELECT count(*) AS c FROM m1 WHERE """ + S.tier("duplicate_ratio") + """ < 10000),
a AS (
  SELECT CAST(sum(raw_events) AS BIGINT) AS total_raw, CAST(sum(unique_events) AS BIGINT) AS total_unique,
         CAST(sum(duplicate_events) AS BIGINT) AS total_duplicates,
         CAST(count(DISTINCT client_id) + coalesce(max(CAST(client_id IS NULL AS INTEGER)), 0) AS BIGINT) AS active_clients,
         CAST(sum(raw_events) FILTER (WHERE use_case_topic = 'usecase_round_1') AS BIGINT) AS br,
         CAST(sum(duplicate_events) FILTER (WHERE use_case_topic = 'usecase_round_1') AS BIGINT) AS bd,
         CAST(sum(raw_events) FILTER (WHERE use_case_topic = 'usecase_round_2') AS BIGINT) AS pr,
         CAST(sum(duplicate_events) FILTER (WHERE use_case_topic = 'usecase_round_2') AS BIGINT) AS pd,
         arg_min(client_id, (-duplicate_ratio, use_case_topic, client_id)) AS replay_client,
         max(duplicate_ratio) AS replay_client_ratio
  FROM allm)
SELECT total_raw, total_unique, total_duplicates, active_clients,
       CASE WHEN total_raw = 0 THEN 0.0 ELSE CAST(total_duplicates AS DOUBLE) / CAST(total_raw AS DOUBLE) END AS total_ratio,
       CAST(greatest(0, br - pr) AS BIGINT) AS load_reduced, CAST(greatest(0, bd - pd) AS BIGINT) AS waste_reduced,
       CASE WHEN br = 0 THEN 0.0 ELSE 100.0 * CAST(greatest(0, br - pr) AS DOUBLE) / CAST(br AS DOUBLE) END AS load_reduction_pct,
       CASE WHEN bd = 0 THEN 0.0 ELSE 100.0 * CAST(greatest(0, bd - pd) AS DOUBLE) / CAST(bd AS DOUBLE) END AS waste_reduction_pct,
       replay_client, replay_client_ratio, (SELECT c FROM thr) AS throttled_decisions
FROM a""")
def q_evidence_report(spark, sf_dir):
    """Totals, reductions, replay client and throttled decisions in one row."""
    lp = _loop(spark, sf_dir)
    return P.evidence_report(lp.metrics1.unionByName(lp.metrics2), lp.decisions.decisions,
                             P.ROUND_1, P.ROUND_2)


# --------------------------------------------------------------------------- four-mode experiment (C5) and its parts

_C5_SQL = f"""WITH RECURSIVE {S.ge_replay('base', 'baseline')}, {S.exact_metrics('base', 'mb')},
lim AS (SELECT client_id, max_by({S.tier('duplicate_ratio')}, use_case_topic) AS l FROM mb GROUP BY client_id),
modes AS (SELECT * FROM (VALUES (0, 'none'), (1, 'static'), (2, 'storage_only'), (3, 'radar')) t(mode_order, experiment_mode)),
ev AS (
  SELECT b.event_id, b.copy_no, b.us, b.client_id, b.event_type, b.entity_id, m.experiment_mode,
         'usecase_experiment_' || m.experiment_mode AS source_topic,
         CASE WHEN m.experiment_mode IN ('none', 'storage_only') THEN 10000 WHEN m.experiment_mode = 'static' THEN 1000
              ELSE greatest(50, coalesce(lim.l, 10000)) END AS limit_per_minute
  FROM base b CROSS JOIN modes m LEFT JOIN lim ON b.client_id = lim.client_id
),
evk AS (SELECT *, sha256(concat_ws(':', source_topic, client_id, event_type, entity_id)) AS dedup_key,
               experiment_mode || '|' || client_id AS bk FROM ev),
{S.token_bucket("(SELECT * FROM evk WHERE experiment_mode IN ('static', 'radar'))", 'limit_per_minute', key='bk',
                order='us, event_id, copy_no', extra='client_id, source_topic, dedup_key, experiment_mode, entity_id, copy_no')},
outv AS (
  SELECT client_id, source_topic, dedup_key, experiment_mode, entity_id, us, event_id, copy_no, admitted, tok, lim
  FROM tb
  UNION ALL
  SELECT client_id, source_topic, dedup_key, experiment_mode, entity_id, us, event_id, copy_no, true, NULL, limit_per_minute
  FROM evk WHERE experiment_mode IN ('none', 'storage_only')
),
acc AS (SELECT * FROM outv WHERE admitted), {S.exact_metrics('acc', 'ma')},
runs AS (SELECT source_topic AS topic, experiment_mode, CAST(count(*) AS BIGINT) AS total_events,
                CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS accepted,
                CAST(count(*) FILTER (WHERE NOT admitted) AS BIGINT) AS rejected
         FROM outv GROUP BY source_topic, experiment_mode),
tt AS (SELECT use_case_topic AS topic, sum(raw_events) AS r, sum(unique_events) AS u, sum(duplicate_events) AS d
       FROM ma GROUP BY use_case_topic),
rm AS (SELECT runs.*, CAST(coalesce(r, 0) AS BIGINT) AS kafka_messages, CAST(coalesce(u, 0) AS BIGINT) AS clean_events,
              CAST(coalesce(d, 0) AS BIGINT) AS duplicate_waste
       FROM runs LEFT JOIN tt ON runs.topic = tt.topic)"""


def _exp(spark, sf_dir):
    return P.mode_experiment(read_table(spark, sf_dir, "events"))


@register("mode_experiment", _C5_SQL + """
SELECT m.mode_order, m.experiment_mode, rm.topic, rm.total_events, rm.accepted, rm.rejected,
       CAST(NULL AS TIMESTAMP) AS saved_at, rm.kafka_messages, rm.clean_events, rm.duplicate_waste,
       """ + S.ratio("rm.duplicate_waste", "rm.kafka_messages") + """ AS duplicate_ratio,
       CAST(coalesce(c.n, 0) AS BIGINT) AS runs
FROM modes m LEFT JOIN rm ON m.experiment_mode = rm.experiment_mode
LEFT JOIN (SELECT experiment_mode, count(*) AS n FROM rm GROUP BY experiment_mode) c ON m.experiment_mode = c.experiment_mode""")
def q_mode_experiment(spark, sf_dir):
    """C5 (+J3, J4, W3): load and waste per experiment mode on the same input."""
    res = _exp(spark, sf_dir).results
    return res.withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))


@register("runs_with_metrics", _C5_SQL + """
SELECT topic, experiment_mode, total_events, accepted, rejected, kafka_messages, clean_events, duplicate_waste,
       """ + S.ratio("duplicate_waste", "kafka_messages") + """ AS duplicate_ratio FROM rm""")
def q_runs_with_metrics(spark, sf_dir):
    """Every run joined with its topic's metric totals."""
    e = _exp(spark, sf_dir)
    return joins.runs_with_metrics(e.runs.drop("saved_at"), e.metrics)


@register("latest_run", _C5_SQL + """
SELECT topic, experiment_mode, total_events, accepted, rejected FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_mode ORDER BY topic DESC) AS rn FROM runs) WHERE rn = 1""")
def q_latest_run(spark, sf_dir):
    """Latest run per mode (last in topic-name order)."""
    return windows.latest_run(_exp(spark, sf_dir).runs).drop("saved_at")


@register("admission_counters", _C5_SQL + """
SELECT client_id, source_topic AS topic, CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE NOT admitted) AS BIGINT) AS blocked
FROM outv GROUP BY client_id, source_topic""")
def q_admission_counters(spark, sf_dir):
    """Accepted and blocked per (client, topic) across the four runs."""
    return admission.admission_counters(_exp(spark, sf_dir).decided)


@register("ingest_summary", _C5_SQL + """
SELECT topic, total_events, accepted, rejected FROM runs""")
def q_ingest_summary(spark, sf_dir):
    """A10: per use-case upload totals."""
    return admission.ingest_summary(_exp(spark, sf_dir).decided, with_rejections=False)


@register("first_rejections", _C5_SQL + """
SELECT topic, CAST(rn AS INTEGER) AS rn, client_id, entity_id FROM (
  SELECT source_topic AS topic, client_id, entity_id,
         row_number() OVER (PARTITION BY source_topic ORDER BY us, event_id, copy_no) AS rn
  FROM outv WHERE NOT admitted) WHERE rn <= 20""")
def q_first_rejections(spark, sf_dir):
    """L4: the first 20 rejections per upload, in arrival order."""
    return admission.first_rejections(_exp(spark, sf_dir).decided, order=("us", "event_id", "copy_no"))


@register("upload_gauges", _C5_SQL + """
SELECT CAST(count(*) AS BIGINT) AS uploads_total, arg_max(total_events, topic) AS last_upload_total_events,
       arg_max(accepted, topic) AS last_upload_accepted, arg_max(rejected, topic) AS last_upload_rejected FROM runs""")
def q_upload_gauges(spark, sf_dir):
    """Upload counter and last-upload gauges."""
    return admission.upload_gauges(_exp(spark, sf_dir).runs)


@register("client_rate_status", _C5_SQL + """,
last AS (SELECT experiment_mode, client_id, arg_max(tok, rn) AS tokens, max(us) AS last_refill, arg_max(lim, rn) AS l FROM tb
         GROUP BY experiment_mode, client_id),
cl AS (SELECT client_id FROM last UNION SELECT client_id FROM lim)
SELECT cl.client_id, 'radar' AS experiment_mode, greatest(50, coalesce(lim.l, 10000)) AS configured_limit_per_minute,
       greatest(50, coalesce(lim.l, 10000)) AS radar_limit_per_minute, 1000 AS static_limit_per_minute,
       r.tokens AS radar_tokens, r.last_refill AS radar_last_refill, r.l AS radar_bucket_limit, greatest(1, r.l) AS radar_bucket_capacity,
       s.tokens AS static_tokens, s.last_refill AS static_last_refill, s.l AS static_bucket_limit, greatest(1, s.l) AS static_bucket_capacity
FROM cl LEFT JOIN lim ON cl.client_id = lim.client_id
LEFT JOIN last r ON r.client_id = cl.client_id AND r.experiment_mode = 'radar'
LEFT JOIN last s ON s.client_id = cl.client_id AND s.experiment_mode = 'static'""")
def q_client_rate_status(spark, sf_dir):
    """Configured, adaptive and static limits with both buckets' final state per client."""
    e = _exp(spark, sf_dir)
    return P.client_rate_status(P.decide(e.baseline).current, P.bucket_state(e.decided))


@register("metrics_snapshot", _C5_SQL + """,
dec AS (SELECT client_id, use_case_topic, duplicate_ratio, """ + S.tier("duplicate_ratio") + """ AS new_limit_per_minute FROM mb),
cnt AS (SELECT client_id, source_topic AS topic, count(*) FILTER (WHERE admitted) AS a, count(*) FILTER (WHERE NOT admitted) AS b
        FROM outv GROUP BY client_id, source_topic)
SELECT 'events_accepted_total' AS metric, 'counter' AS type, NULL AS client_id, NULL AS topic, CAST(coalesce(sum(a), 0) AS DOUBLE) AS value FROM cnt
UNION ALL SELECT 'events_blocked_total', 'counter', NULL, NULL, CAST(coalesce(sum(b), 0) AS DOUBLE) FROM cnt
UNION ALL SELECT 'uploads_total', 'counter', NULL, NULL, CAST(count(*) AS DOUBLE) FROM runs
UNION ALL SELECT 'last_upload_total_events', 'gauge', NULL, NULL, CAST(coalesce(arg_max(total_events, topic), 0) AS DOUBLE) FROM runs
UNION ALL SELECT 'last_upload_accepted', 'gauge', NULL, NULL, CAST(coalesce(arg_max(accepted, topic), 0) AS DOUBLE) FROM runs
UNION ALL SELECT 'last_upload_rejected', 'gauge', NULL, NULL, CAST(coalesce(arg_max(rejected, topic), 0) AS DOUBLE) FROM runs
UNION ALL SELECT 'clients_throttled_total', 'counter', NULL, NULL, CAST(count(*) FILTER (WHERE new_limit_per_minute < 10000) AS DOUBLE) FROM dec
UNION ALL SELECT 'events_accepted_by_client_total', 'counter', client_id, topic, CAST(a AS DOUBLE) FROM cnt WHERE a > 0
UNION ALL SELECT 'events_blocked_by_client_total', 'counter', client_id, topic, CAST(b AS DOUBLE) FROM cnt WHERE b > 0
UNION ALL SELECT 'duplicate_ratio', 'gauge', client_id, use_case_topic, duplicate_ratio FROM dec
UNION ALL SELECT 'adaptive_limit', 'gauge', client_id, use_case_topic, CAST(new_limit_per_minute AS DOUBLE) FROM dec""")
def q_metrics_snapshot(spark, sf_dir):
    """Every counter and gauge as rows (metric, type, client_id, topic, value)."""
    e = _exp(spark, sf_dir)
    return P.metrics_snapshot(e.events, e.runs, P.decide(e.baseline).decisions)


@register("client_scorecard", _C5_SQL + """,
dec AS (SELECT client_id, use_case_topic AS topic, duplicate_ratio, """ + S.tier("duplicate_ratio") + """ AS adaptive_limit FROM ma
        WHERE use_case_topic <> 'usecase_experiment_static'
        UNION ALL SELECT client_id, use_case_topic, duplicate_ratio, """ + S.tier("duplicate_ratio") + """ FROM mb),
cnt AS (SELECT client_id, source_topic AS topic, count(*) FILTER (WHERE admitted) AS accepted,
               count(*) FILTER (WHERE NOT admitted) AS blocked FROM outv GROUP BY client_id, source_topic)
SELECT coalesce(cnt.client_id, dec.client_id) AS client_id, coalesce(cnt.topic, dec.topic) AS topic,
       CAST(coalesce(accepted, 0) AS BIGINT) AS accepted, CAST(coalesce(blocked, 0) AS BIGINT) AS blocked,
       duplicate_ratio, adaptive_limit
FROM cnt FULL OUTER JOIN dec ON cnt.client_id = dec.client_id AND cnt.topic = dec.topic""")
def q_client_scorecard(spark, sf_dir):
    """Per (client, topic) accepted / blocked with the decision's ratio and limit; rows
    of both sides (three of the experiment's topics), of one side only (the static topic
    has no decision, the baseline no counters)."""
    e = _exp(spark, sf_dir)
    decided = e.metrics.filter(F.col("use_case_topic") != "usecase_experiment_static").unionByName(e.baseline)
    return joins.client_scorecard(admission.admission_counters(e.events), P.decide(decided).decisions)


# A13 / J7 / S2 read a log that write_log wrote. The static topic's messages of user
# ids divisible by 10 get lost, the adaptive topic's are published twice; one topic
# is never published and another has no run.
_LOG_SQL = _C5_SQL + """,
sent AS (
  SELECT source_topic AS topic, client_id, entity_id, us, event_id, copy_no, 0 AS again FROM acc
  WHERE source_topic <> 'usecase_experiment_storage_only'
    AND NOT (source_topic = 'usecase_experiment_static' AND CAST(substr(client_id, 2) AS INTEGER) % 10 = 0)
  UNION ALL SELECT source_topic, client_id, entity_id, us, event_id, copy_no, 1 FROM acc
  WHERE source_topic = 'usecase_experiment_radar' AND CAST(substr(client_id, 2) AS INTEGER) % 10 = 0
  UNION ALL SELECT 'raw_events', client_id, entity_id, us, event_id, copy_no, 0 FROM base WHERE event_type = 'click'
),
logged AS (SELECT *, event_id % 4 AS part,
                  row_number() OVER (PARTITION BY topic, event_id % 4 ORDER BY again, us, event_id, copy_no) - 1 AS pos FROM sent)"""


def _publish_log(spark, sf_dir):
    """(experiment, path of the log); the second publication is appended in a write of its own."""
    e = _exp(spark, sf_dir)
    path = scratch_path(spark, "log")
    accepted = e.events.filter("admitted")
    tenth = F.substring("client_id", 2, 20).cast("int") % 10 == 0
    topic = F.col("source_topic")
    raw = P.replay_events(read_table(spark, sf_dir, "events"), "raw_events").filter("event_type = 'click'")
    cols = ["client_id", "event_type", "entity_id", "source_topic", "us", "event_id", "copy_no"]
    first = accepted.filter(~((topic == "usecase_experiment_storage_only") | ((topic == "usecase_experiment_static") & tenth)))
    for part in (first.select(*cols).unionByName(raw.select(*cols)), accepted.filter((topic == "usecase_experiment_radar") & tenth).select(*cols)):
        IO.write_log(part, path, order=("us", "event_id", "copy_no"), partition=F.col("event_id") % 4)
    return e, path


@register("offset_totals", _LOG_SQL + """
SELECT topic, CAST(sum(n) AS BIGINT) AS messages, count(*) AS partitions
FROM (SELECT topic, part, max(pos) - min(pos) + 1 AS n FROM logged GROUP BY topic, part) GROUP BY topic""")
def q_offset_totals(spark, sf_dir):
    """Messages and partitions per topic from the offsets of the written log."""
    return admission.offset_totals(IO.read_log(spark, _publish_log(spark, sf_dir)[1]))


@register("reconcile_offsets", _LOG_SQL + """,
m AS (SELECT topic, count(*) AS messages FROM logged GROUP BY topic)
SELECT coalesce(runs.topic, m.topic) AS topic, accepted, messages, coalesce(messages, 0) - coalesce(accepted, 0) AS delta
FROM runs FULL OUTER JOIN m ON runs.topic = m.topic""")
def q_reconcile_offsets(spark, sf_dir):
    """Accepted count per upload against the log: lost, repeated, unpublished and foreign messages."""
    e, path = _publish_log(spark, sf_dir)
    return joins.reconcile_offsets(e.runs, admission.offset_totals(IO.read_log(spark, path)))


@register("topic_head", _LOG_SQL + """
SELECT part AS "partition", pos AS "offset", client_id, entity_id FROM logged WHERE topic = 'usecase_experiment_radar'
ORDER BY part, pos LIMIT 2500""")
def q_topic_head(spark, sf_dir):
    """The first 2500 messages of a topic, in (partition, offset) order."""
    head = IO.read_topic(spark, "usecase_experiment_radar", fmt="log", path=_publish_log(spark, sf_dir)[1], n=2500)
    return enrich.decode_events(head).select("partition", "offset", "client_id", "entity_id")


@register("topic_offsets", _LOG_SQL + """
SELECT topic, part AS "partition", pos AS "offset", client_id, entity_id FROM logged""")
def q_topic_offsets(spark, sf_dir):
    """S6 and S2 whole: every message of the log at its partition and offset."""
    log = IO.read_log(spark, _publish_log(spark, sf_dir)[1])
    return enrich.decode_events(log).select(F.col("kafka_topic").alias("topic"), "partition", "offset", "client_id", "entity_id")


# --------------------------------------------------------------------------- limits, lookups, windows, filters

from ..functions import policy as PF  # noqa: E402
from ..functions import text as TF  # noqa: E402
from ..operators import enrich, filters  # noqa: E402

_BDEC = f"""{S.GE}, {S.BATCH_METRICS},
bdec AS (SELECT client_id, use_case_topic, duplicate_ratio, {S.tier('duplicate_ratio')} AS new_limit_per_minute,
                batch_time AS decided_at, batch_time + INTERVAL 3600 SECOND AS valid_until FROM bm),
cur AS (SELECT client_id, arg_max(new_limit_per_minute, (decided_at, use_case_topic)) AS limit_per_minute,
               arg_max(use_case_topic, (decided_at, use_case_topic)) AS use_case_topic,
               arg_max(duplicate_ratio, (decided_at, use_case_topic)) AS duplicate_ratio,
               max(decided_at) AS decided_at, arg_max(valid_until, (decided_at, use_case_topic)) AS valid_until
        FROM bdec GROUP BY client_id)"""


def _batch_decisions(spark, sf_dir):
    return limits.decide_limits(_batch_metrics(spark, sf_dir), decided_at=F.col("batch_time"))


@register("current_limits", f"""WITH {_BDEC}
SELECT client_id, limit_per_minute, use_case_topic, duplicate_ratio, decided_at, valid_until FROM cur""")
def q_current_limits(spark, sf_dir):
    """Last-write-wins limit per client over per-batch decisions (C2 per batch)."""
    return limits.current_limits(_batch_decisions(spark, sf_dir)).select(
        "client_id", "limit_per_minute", "use_case_topic", "duplicate_ratio", ntz("decided_at"), ntz("valid_until"))


@register("limits_join", f"""WITH {_BDEC}
SELECT ge.event_id, ge.client_id, CAST(greatest(50, coalesce(cur.limit_per_minute, 10000)) AS INTEGER) AS limit_per_minute
FROM ge LEFT JOIN cur ON ge.client_id = cur.client_id""")
def q_limits_join(spark, sf_dir):
    """Each event's effective adaptive limit from the current-limit table."""
    cur = limits.current_limits(_batch_decisions(spark, sf_dir))
    ev = load_ge(spark, sf_dir).select("event_id", "client_id")
    return limits.with_limits(ev, cur)


@register("limits_asof", f"""WITH {_BDEC},
per_at AS (SELECT client_id, decided_at, arg_max(new_limit_per_minute, use_case_topic) AS l,
                  arg_max(valid_until, use_case_topic) AS vu FROM bdec GROUP BY client_id, decided_at)
SELECT e.event_id, e.client_id,
       CAST(CASE WHEN p.decided_at IS NOT NULL AND e.event_ts < p.vu THEN greatest(50, p.l) ELSE 10000 END AS INTEGER)
         AS limit_per_minute,
       CASE WHEN p.decided_at IS NOT NULL AND e.event_ts < p.vu THEN p.decided_at END AS decided_at
FROM ge e ASOF LEFT JOIN per_at p ON e.client_id = p.client_id AND e.event_ts >= p.decided_at""")
def q_limits_asof(spark, sf_dir):
    """The limit in force at each event's time (latest decision, within its TTL)."""
    hist = _batch_decisions(spark, sf_dir)
    ev = load_ge(spark, sf_dir).select("event_id", "client_id", "event_ts")
    return limits.with_limits_asof(ev, hist).select("event_id", "client_id", "limit_per_minute", ntz("decided_at"))


@register("metrics_with_limits", f"""WITH {_BDEC},
cm AS ({_ROLLUP_SQL.format(where="")})
SELECT cm.*, greatest(50, coalesce(cur.limit_per_minute, 10000)) AS configured_limit_per_minute,
       greatest(50, coalesce(cur.limit_per_minute, 10000)) AS radar_limit_per_minute, 1000 AS static_limit_per_minute
FROM cm LEFT JOIN cur ON cm.client_id = cur.client_id""")
def q_metrics_with_limits(spark, sf_dir):
    """Metric rows with each client's configured, adaptive and static limits."""
    bm = _batch_metrics(spark, sf_dir)
    cur = limits.current_limits(limits.decide_limits(bm, decided_at=F.col("batch_time")))
    return joins.metrics_with_limits(metrics.client_metrics(bm, minutes=None, ordered=False), cur)


@register("gauge_series", f"""WITH {_BDEC}
SELECT client_id, use_case_topic, time_bucket(INTERVAL 1 HOUR, decided_at) AS slot_start,
       arg_max(duplicate_ratio, decided_at) * 100.0 AS duplicate_ratio_pct,
       arg_max(new_limit_per_minute, decided_at) AS limit_per_minute
FROM bdec GROUP BY client_id, use_case_topic, time_bucket(INTERVAL 1 HOUR, decided_at)""")
def q_gauge_series(spark, sf_dir):
    """Per (client, topic) and hour, the last decision's ratio (x100) and limit."""
    g = windows.gauge_series(_batch_decisions(spark, sf_dir))
    return g.withColumn("slot_start", F.col("slot_start").cast("timestamp_ntz"))


@register("admission_rate", f"""WITH RECURSIVE {S.GE}, {S.token_bucket('ge', '50', extra='event_ts')},
w AS (SELECT admitted, epoch_us(event_ts) - epoch_us(event_ts) % 5000000 - j * 5000000 AS s
      FROM tb, (SELECT unnest(range(0, 6)) AS j))
SELECT make_timestamp(s) AS window_start, make_timestamp(s + 30000000) AS window_end,
       CAST(count(*) FILTER (WHERE admitted) AS DOUBLE) / CAST(30 AS DOUBLE) AS accepted_per_s,
       CAST(count(*) FILTER (WHERE NOT admitted) AS DOUBLE) / CAST(30 AS DOUBLE) AS blocked_per_s
FROM w GROUP BY s""")
def q_admission_rate(spark, sf_dir):
    """Accepted / blocked per second over a trailing 30 s window every 5 s."""
    ge = load_ge(spark, sf_dir).select("event_id", "client_id", "us", "event_ts")
    adm = admission.token_bucket(ge, 50)
    r = windows.admission_rate(adm)
    return r.select(ntz("window_start"), ntz("window_end"), "accepted_per_s", "blocked_per_s")


@register("for_topic", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT batch_id, use_case_topic, client_id, raw_events FROM bm WHERE coalesce(use_case_topic, 'raw_events') = 'usecase_view'""")
def q_for_topic(spark, sf_dir):
    """one topic's metric rows."""
    return filters.for_topic(_batch_metrics(spark, sf_dir), "usecase_view").select(
        "batch_id", "use_case_topic", "client_id", "raw_events")


@register("for_topics", f"""WITH {S.GE}, {S.BATCH_METRICS}
SELECT use_case_topic, CAST(sum(raw_events) AS BIGINT) AS kafka_messages, CAST(sum(unique_events) AS BIGINT) AS clean_events,
       CAST(sum(duplicate_events) AS BIGINT) AS spark_waste
FROM bm WHERE use_case_topic IN ('usecase_click', 'usecase_purchase') GROUP BY use_case_topic""")
def q_for_topics(spark, sf_dir):
    """F3 + A4: totals for a list of topics (the round-comparison query shape)."""
    t = metrics.topic_totals(filters.for_topics(_batch_metrics(spark, sf_dir), ["usecase_click", "usecase_purchase"]))
    return t.select("use_case_topic", F.col("raw_events").alias("kafka_messages"),
                    F.col("unique_events").alias("clean_events"), F.col("duplicate_events").alias("spark_waste"))


@register("subscribed_topics", f"""WITH {S.GE},
c AS (SELECT source_topic AS topic FROM ge UNION SELECT event_type FROM ge UNION SELECT 'raw_events'
      UNION SELECT event_type || '_raw_events' FROM ge UNION SELECT 'x' || source_topic FROM ge)
SELECT topic FROM c WHERE regexp_full_match(topic, 'raw_events|usecase_.*')""")
def q_subscribed_topics(spark, sf_dir):
    """candidate topic names (from the data) that the subscription pattern picks up."""
    ge = load_ge(spark, sf_dir)
    c = (ge.select(F.col("source_topic").alias("topic"))
         .union(ge.select(F.col("event_type").alias("topic")))
         .union(ge.select(F.lit("raw_events").alias("topic")))
         .union(ge.select(F.concat("event_type", F.lit("_raw_events")).alias("topic")))
         .union(ge.select(F.concat(F.lit("x"), "source_topic").alias("topic")))).distinct()
    return filters.match_topics(c)


# --------------------------------------------------------------------------- scalar function families

_NAME_SQL = "'  ' || upper(event_type) || ' Replay #' || CAST(user_id % 7 AS VARCHAR) || '!! '"
_TOPIC_SQL = """'usecase_' || substr(CASE WHEN s = '' THEN 'upload' ELSE s END, 1, 80)"""


@register("name_functions", f"""WITH {S.GE},
n AS (SELECT event_id, {_NAME_SQL} AS raw_name, '/uploads/' || event_type || '_' || CAST(user_id AS VARCHAR) || '.csv' AS path FROM ge),
s AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(raw_name, '^\\s+|\\s+$', '', 'g')),
                '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM n)
SELECT event_id, raw_name, {_TOPIC_SQL} AS topic,
       CASE WHEN regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]+$', '') = '' THEN 'Uploaded Use Case'
            ELSE regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]+$', '') END AS use_case
FROM s""")
def q_name_functions(spark, sf_dir):
    """P9 topic names and P20 use-case names from file paths."""
    ge = load_ge(spark, sf_dir)
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" Replay #"), (F.col("user_id") % 7).cast("string"), F.lit("!! "))
    path = F.concat(F.lit("/uploads/"), F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit(".csv"))
    return ge.select("event_id", raw.alias("raw_name"), TF.topic_name(raw).alias("topic"),
                     TF.use_case_from_path(path).alias("use_case"))


_MODE_CANDIDATES = ["NULL", "''", "' RADAR '", "'   '", "'foo'", "'Static'", "'storage_only'"]


@register("mode_functions", f"""WITH {S.GE}, {S.exact_metrics('ge')},
lim AS (SELECT client_id, max_by({S.tier('duplicate_ratio')}, use_case_topic) AS l FROM em GROUP BY client_id),
m AS (SELECT ge.event_id, ge.client_id, [{', '.join(_MODE_CANDIDATES)}][1 + ge.user_id % 7] AS raw_mode, lim.l
      FROM ge LEFT JOIN lim ON ge.client_id = lim.client_id),
n AS (SELECT *, lower(regexp_replace(coalesce(nullif(raw_mode, ''), 'radar'), '^\\s+|\\s+$', '', 'g')) AS s FROM m),
v AS (SELECT *, CASE WHEN s IN ('none', 'static', 'storage_only', 'radar') THEN s END AS mode FROM n)
SELECT event_id, raw_mode, mode, mode IS NOT NULL AS valid,
       CASE WHEN mode IN ('none', 'storage_only') THEN 10000 WHEN mode = 'static' THEN 1000
            WHEN l IS NULL THEN 10000 ELSE greatest(50, l) END AS limit_per_minute,
       CASE WHEN mode IN ('none', 'storage_only') THEN 'bypass_rate_limit' WHEN mode = 'static' THEN 'static_token_bucket'
            ELSE 'radar_adaptive_token_bucket' END AS strategy,
       CASE WHEN mode IN ('none', 'storage_only') THEN 'bypass' WHEN mode = 'static' THEN 'static_token_bucket'
            ELSE 'radar_adaptive_token_bucket' END AS upload_strategy
FROM v""")
def q_mode_functions(spark, sf_dir):
    """P10 mode normalisation, P16 effective limit, P17 strategy labels (mode text per user)."""
    ge = load_ge(spark, sf_dir)
    cur = limits.current_limits(limits.decide_limits(metrics.exact_metrics(ge)))
    cands = F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" RADAR "), F.lit("   "), F.lit("foo"),
                    F.lit("Static"), F.lit("storage_only"))
    ev = ge.select("event_id", "client_id", F.element_at(cands, (F.col("user_id") % 7 + 1).cast("int")).alias("raw_mode"))
    ev = ev.join(cur.select("client_id", F.col("limit_per_minute").cast("string").alias("_stored")), "client_id", "left")
    mode = TF.normalize_mode("raw_mode")
    return ev.select("event_id", "raw_mode", mode.alias("mode"), mode.isNotNull().alias("valid"),
                     PF.effective_limit(mode, "_stored").alias("limit_per_minute"),
                     PF.strategy_label(mode).alias("strategy"),
                     PF.strategy_label(mode, per_upload=True).alias("upload_strategy"))


@register("payload_functions", f"""WITH {S.GE}
SELECT event_id,
       CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_extract_string(props, '$.k') END AS payload_k,
       CASE WHEN event_type = '' THEN NULL WHEN json_valid(event_type) AND json_type(event_type) = 'OBJECT' THEN NULL
            ELSE event_type END AS payload_value,
       CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL
                 OR isnan(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))
                 OR isinf(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) THEN 0.0
            ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k_number,
       CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NULL THEN 0.0 ELSE TRY_CAST(event_type AS DOUBLE) END AS type_number,
       value AS value_number
FROM (SELECT ge.*, e.props FROM ge JOIN events e ON ge.event_id = e.event_id)""")
def q_payload_functions(spark, sf_dir):
    """P11 payload text -> map (object, or {{value: text}}), P13 safe numbers."""
    from ..sources.tables import read_table as rt
    ev = rt(spark, sf_dir, "events")
    p1 = TF.parse_payload("props")
    p2 = TF.parse_payload("event_type")
    return ev.select("event_id", p1["k"].alias("payload_k"), p2["value"].alias("payload_value"),
                     PF.to_number(F.get_json_object("props", "$.k")).alias("k_number"),
                     PF.to_number("event_type").alias("type_number"),
                     PF.to_number("value").alias("value_number"))


@register("health_labels", f"""WITH {S.GE}, {S.exact_metrics('ge')}
SELECT use_case_topic, client_id, duplicate_ratio,
       CASE WHEN duplicate_ratio >= 0.5 THEN 'Replay risk' WHEN duplicate_ratio >= 0.15 THEN 'Watch' ELSE 'Healthy' END AS health,
       CAST((duplicate_events * 2000 + raw_events) // (raw_events * 2) // 10 AS VARCHAR) || '.' ||
       CAST((duplicate_events * 2000 + raw_events) // (raw_events * 2) % 10 AS VARCHAR) || '%' AS ratio_text
FROM em""")
def q_health_labels(spark, sf_dir):
    """P18 health label and P19 percent text per (topic, client)."""
    m = metrics.exact_metrics(load_ge(spark, sf_dir))
    return m.select("use_case_topic", "client_id", "duplicate_ratio",
                    PF.health_label("duplicate_ratio").alias("health"),
                    PF.percent_text("duplicate_events", "raw_events").alias("ratio_text"))


# --------------------------------------------------------------------------- wire format, uploads, streams

from ..session import scratch_path  # noqa: E402
from ..sources import io as IO  # noqa: E402
from ..streaming import admission as SA  # noqa: E402
from ..streaming import dedup as SD  # noqa: E402
from ..streaming import pipeline as SP  # noqa: E402

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
_INGESTED_AT = "2024-02-01 00:00:00"


def _wire_rows(spark, sf_dir) -> DataFrame:
    """Gateway events as they go on the wire: ISO event time, payload map, the
    use case left out on 'view' events and the topic left out of the body on
    'error' events (the consumer falls back to the log's topic for both)."""
    ge = load_ge(spark, sf_dir)
    return ge.select(
        F.col("source_topic").alias("log_topic"), "client_id", "event_type", "entity_id",
        F.date_format("event_ts", _ISO).alias("event_time"), "payload",
        F.when(F.col("event_type") != "view", F.col("use_case_id")).alias("use_case_id"),
        F.when(F.col("event_type") != "error", F.col("source_topic")).alias("source_topic"),
        F.lit("radar").alias("experiment_mode"))


_WIRE_SQL = f"""WITH {S.GE}
SELECT source_topic AS kafka_topic, client_id, event_type, entity_id,
       strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS event_time,
       source_topic, source_topic AS use_case_id, event_ts, dedup_key, false AS is_malformed
FROM ge"""


@register("wire_roundtrip", _WIRE_SQL)
def q_wire_roundtrip(spark, sf_dir):
    """S6 encode -> P1 decode -> P2-P6 enrich: the consumer's view of published events."""
    msgs = enrich.encode_events(_wire_rows(spark, sf_dir), topic_col="log_topic")
    ev = enrich.enrich_events(enrich.decode_events(msgs), ingested_at=_INGESTED_AT)
    return ev.select("kafka_topic", "client_id", "event_type", "entity_id", "event_time", "source_topic",
                     "use_case_id", ntz("event_ts"), "dedup_key", "is_malformed")


def _publish(spark, sf_dir) -> str:
    path = scratch_path(spark, "topics")
    IO.write_events(_wire_rows(spark, sf_dir).withColumn("source_topic", F.col("log_topic")), fmt="files", path=path)
    return path


_STREAM_KEYS_SQL = f"""WITH {S.GE}
SELECT DISTINCT dedup_key, source_topic, client_id, event_type, entity_id FROM ge"""


@register("stream_dedup", _STREAM_KEYS_SQL)
def q_stream_dedup(spark, sf_dir):
    """C3 clean side: S1 subscribe (file log) -> P1-P6 -> T1 watermark -> T2 dedup -> S7 Parquet sink,
    run to completion with an availableNow trigger; the clean table's keys."""
    src = _publish(spark, sf_dir)
    out, ck = scratch_path(spark, "clean"), scratch_path(spark, "ckpt")
    q = SP.write_clean_events(SD.dedup_stream(SP.event_stream(spark, "files", path=src)), out, ck,
                              trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(out).select("dedup_key", "source_topic", "client_id", "event_type", "entity_id")


@register("stream_bounded_dedup", _STREAM_KEYS_SQL)
def q_stream_bounded_dedup(spark, sf_dir):
    """Dedup within the watermark horizon (one micro-batch here, so every key once)."""
    src = _publish(spark, sf_dir)
    out, ck = scratch_path(spark, "clean"), scratch_path(spark, "ckpt")
    q = SP.write_clean_events(SD.dedup_stream_bounded(SP.event_stream(spark, "files", path=src)), out, ck,
                              trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(out).select("dedup_key", "source_topic", "client_id", "event_type", "entity_id")


@register("stream_metrics", f"""WITH {S.GE}
SELECT source_topic AS use_case_topic, client_id, CAST(count(*) AS BIGINT) AS raw_events FROM ge
GROUP BY source_topic, client_id""")
def q_stream_metrics(spark, sf_dir):
    """C3 metrics side: foreachBatch per-batch metrics (S8/T6) written by batch id, read back
    and summed; raw counts are additive across micro-batches."""
    src = _publish(spark, sf_dir)
    out, ck = scratch_path(spark, "metrics"), scratch_path(spark, "ckpt")
    q = SP.write_metrics(SP.event_stream(spark, "files", path=src), out, ck, trigger={"availableNow": True},
                         batch_time=_INGESTED_AT)
    q.awaitTermination()
    m = IO.read_metrics(spark, out)
    return m.groupBy("use_case_topic", "client_id").agg(F.sum("raw_events").cast("long").alias("raw_events"))


@register("stream_admission", f"""WITH RECURSIVE {S.GE}, {S.token_bucket('ge', '50')}
SELECT event_id, k AS client_id, admitted, tok AS tokens FROM tb""")
def q_stream_admission(spark, sf_dir):
    """T8 on a stream (transformWithStateInPandas, keyed state with TTL) over the gateway events."""
    src = scratch_path(spark, "admit_src")
    load_ge(spark, sf_dir).select("event_id", "client_id", "us", F.lit(50).alias("limit_per_minute")) \
        .write.parquet(src)
    stream = spark.readStream.schema("event_id long, client_id string, us long, limit_per_minute int").parquet(src)
    out, ck = scratch_path(spark, "admitted"), scratch_path(spark, "ckpt")
    with SA.state_in_rocksdb(spark):
        q = (SA.admit_stream(stream, ttl_s=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "client_id", "admitted", "tokens")


def _upload_metrics_sql(topic):
    return f"""WITH {S.GE},
u AS (SELECT ge.client_id, ge.event_type, ge.entity_id, '{topic}' AS source_topic,
             sha256(concat_ws(':', '{topic}', ge.client_id, ge.event_type, ge.entity_id)) AS dedup_key,
             TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
             CASE WHEN ge.event_type = 'click' THEN NULL ELSE ge.event_ts END AS et
      FROM ge JOIN events e ON ge.event_id = e.event_id),
{S.exact_metrics('u')},
x AS (SELECT client_id, CAST(sum(k) AS BIGINT) AS payload_k_sum, CAST(count(et) AS BIGINT) AS with_event_time
      FROM u GROUP BY client_id)
SELECT em.client_id, raw_events, unique_events, duplicate_events, duplicate_ratio, payload_k_sum, with_event_time
FROM em JOIN x ON em.client_id = x.client_id"""


def _upload_rows(spark, sf_dir) -> DataFrame:
    return load_ge(spark, sf_dir, with_props=True).select(
        "client_id", "event_type", "entity_id",
        F.when(F.col("event_type") != "click", F.date_format("event_ts", _ISO)).alias("event_time"),
        F.col("props").alias("payload_text"), "batch_id")


def _upload_metrics(events: DataFrame, name: str) -> DataFrame:
    from ..operators.enrich import stamp_use_case
    ev = stamp_use_case(events, name, "radar").withColumn("dedup_key", P.dedup_key())
    m = metrics.exact_metrics(ev)
    x = ev.groupBy("client_id").agg(
        F.sum(F.col("payload")["k"].try_cast("long")).alias("payload_k_sum"),
        F.count("event_time").alias("with_event_time"))
    return m.join(x, "client_id").select("client_id", "raw_events", "unique_events", "duplicate_events",
                                         "duplicate_ratio", "payload_k_sum", "with_event_time")


@register("csv_upload", _upload_metrics_sql("usecase_csv_upload"))
def q_csv_upload(spark, sf_dir):
    """S3: CSV upload (quoted JSON payload cells, empty cells) read back and measured."""
    path = scratch_path(spark, "csv")
    _upload_rows(spark, sf_dir).select("client_id", "event_type", "entity_id",
                                       F.coalesce("event_time", F.lit("")).alias("event_time"),
                                       F.col("payload_text").alias("payload")) \
        .write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return _upload_metrics(IO.read_events_csv(spark, path), "CSV Upload")


@register("jsonl_upload", _upload_metrics_sql("usecase_jsonl_upload"))
def q_jsonl_upload(spark, sf_dir):
    """JSON-lines upload read back with FAILFAST and measured."""
    path = scratch_path(spark, "jsonl")
    rows = _upload_rows(spark, sf_dir)
    rows.select(F.to_json(F.struct("client_id", "event_type", "entity_id", "event_time",
                                   F.from_json("payload_text", "map<string,string>").alias("payload"))).alias("value")) \
        .write.text(path)
    return _upload_metrics(IO.read_events_jsonl(spark, path), "JSONL Upload")


@register("json_array_upload", _upload_metrics_sql("usecase_json_array_upload"))
def q_json_array_upload(spark, sf_dir):
    """JSON-array upload files (one array per stand-in batch of at most 1000 events)."""
    path = scratch_path(spark, "jsonarray")
    rows = _upload_rows(spark, sf_dir)
    obj = F.to_json(F.struct("client_id", "event_type", "entity_id", "event_time",
                             F.from_json("payload_text", "map<string,string>").alias("payload")))
    arrays = rows.groupBy("batch_id").agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(obj)), F.lit("]")).alias("value"))
    # one array per file: a multi-line JSON document is a whole file
    arrays.repartition("batch_id").write.partitionBy("batch_id").text(path)
    return _upload_metrics(IO.read_events_json_array(spark, path), "JSON Array Upload")


@register("gateway_ingest", f"""WITH RECURSIVE {S.GE}, {S.exact_metrics('ge')},
lim AS (SELECT client_id, max_by({S.tier('duplicate_ratio')}, use_case_topic) AS l FROM em GROUP BY client_id),
ev AS (SELECT ge.*, greatest(50, coalesce(lim.l, 10000)) AS limit_per_minute FROM ge LEFT JOIN lim ON ge.client_id = lim.client_id),
{S.token_bucket('ev', 'limit_per_minute')}
SELECT k AS client_id, 'usecase_replay_attack_demo' AS topic, CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE NOT admitted) AS BIGINT) AS rejected, min(lim) AS limit_per_minute
FROM tb GROUP BY k""")
def q_gateway_ingest(spark, sf_dir):
    """One upload in adaptive mode with limits from the exact ratios: validate, default, stamp,
    look up limits, bucket, split; accepted / rejected per client."""
    ge = load_ge(spark, sf_dir)
    cur = P.decide(metrics.exact_metrics(ge)).current
    up = ge.select("event_id", "client_id", "event_type", "entity_id", "us")
    res = P.ingest(up, "Replay Attack Demo", "radar", cur, now=_INGESTED_AT)
    return res.events.groupBy("client_id", F.col("source_topic").alias("topic")).agg(
        F.count_if("admitted").alias("accepted"), F.count_if(~F.col("admitted")).alias("rejected"),
        F.min("limit_per_minute").alias("limit_per_minute"))


# --------------------------------------------------------------------------- stores

@register("limits_store", f"""WITH {_BDEC},
as_of_t AS (SELECT max(decided_at) AS t FROM bdec),
live AS (SELECT * FROM bdec WHERE decided_at <= (SELECT t FROM as_of_t) AND valid_until > (SELECT t FROM as_of_t))
SELECT client_id, arg_max(new_limit_per_minute, (decided_at, use_case_topic)) AS limit_per_minute,
       arg_max(use_case_topic, (decided_at, use_case_topic)) AS use_case_topic,
       arg_max(duplicate_ratio, (decided_at, use_case_topic)) AS duplicate_ratio,
       max(decided_at) AS decided_at, arg_max(valid_until, (decided_at, use_case_topic)) AS valid_until
FROM live GROUP BY client_id""")
def q_limits_store(spark, sf_dir):
    """S10 append decisions to the limit history, S11 read the limits live at the latest decision time."""
    path = scratch_path(spark, "limits")
    IO.write_limits(_batch_decisions(spark, sf_dir), path)
    as_of = spark.read.parquet(path).select(F.max("decided_at")).scalar()
    out = IO.read_limits(spark, path, as_of=as_of)
    return out.select("client_id", "limit_per_minute", "use_case_topic", "duplicate_ratio", ntz("decided_at"),
                      ntz("valid_until"))


_T1, _T2, _AS_OF = "2024-02-01 00:00:00", "2024-02-01 01:00:00", "2024-02-01 02:00:00"


@register("runs_store", _C5_SQL + f"""
SELECT topic, experiment_mode, total_events, accepted * 2 AS accepted, rejected, TIMESTAMP '{_T2}' AS saved_at FROM runs""")
def q_runs_store(spark, sf_dir):
    """Runs appended twice (a re-run of every topic); the store keeps the latest live row per topic."""
    path = scratch_path(spark, "runs")
    runs = _exp(spark, sf_dir).runs
    IO.write_runs(runs.withColumn("saved_at", F.lit(_T1).cast("timestamp")), path)
    IO.write_runs(runs.withColumn("accepted", F.col("accepted") * 2).withColumn("saved_at", F.lit(_T2).cast("timestamp")),
                  path)
    return IO.read_runs(spark, path, as_of=_AS_OF).withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))


from . import state_queries  # noqa: E402, F401  (registers its own)

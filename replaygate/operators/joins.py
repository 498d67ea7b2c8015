"""Lookups at table scale: runs x metrics, modes x runs, baseline x protected,
metrics x limits, offsets reconciliation, per-client scorecard (J3-J8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import dup_ratio, effective_limit
from ..schema import BASELINE_PATTERN, DEFAULT_POLICY, MODES, PROTECTED_PATTERN, Policy
from .metrics import TOPIC, topic_totals


def runs_with_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each run with its topic's totals (0 when the topic has no metrics)."""
    tot = topic_totals(metrics).select(F.col(TOPIC).alias("topic"), "raw_events", "unique_events", "duplicate_events")
    out = runs.join(tot, "topic", "left")
    return out.select(
        *runs.columns,
        F.coalesce("raw_events", F.lit(0)).cast("long").alias("kafka_messages"),
        F.coalesce("unique_events", F.lit(0)).cast("long").alias("clean_events"),
        F.coalesce("duplicate_events", F.lit(0)).cast("long").alias("duplicate_waste"),
    ).withColumn("duplicate_ratio", dup_ratio("duplicate_waste", "kafka_messages"))


def modes_frame(spark) -> DataFrame:
    """The four experiment modes in display order (a 4-row dimension)."""
    return spark.createDataFrame(list(enumerate(MODES)), "mode_order int, experiment_mode string")


def results_by_mode(runs_metrics: DataFrame) -> DataFrame:
    """J4 + W3: every mode appears; its latest run is the last in topic-name order."""
    from pyspark.sql import Window
    w = Window.partitionBy("experiment_mode").orderBy(F.desc("topic"))
    latest = runs_metrics.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    counts = runs_metrics.groupBy("experiment_mode").agg(F.count(F.lit(1)).alias("runs"))
    modes = modes_frame(runs_metrics.sparkSession)
    return (modes.join(latest, "experiment_mode", "left")
                 .join(counts, "experiment_mode", "left")
                 .withColumn("runs", F.coalesce("runs", F.lit(0)).cast("long")))


def guess_comparison(metrics: DataFrame) -> DataFrame:
    """baseline = first topic matching round_1|baseline (else the first topic);
    protected = first matching round_2|protected (else the first other topic).
    Topic order is name order. Two scalar subqueries, no collection of topics."""
    t = metrics.select(F.coalesce(F.col(TOPIC), F.lit("raw_events")).alias("t"))
    first = t.select(F.min("t")).scalar()
    second = t.filter(F.col("t") > first).select(F.min("t")).scalar()
    g = t.agg(F.min(F.when(F.col("t").rlike(BASELINE_PATTERN), F.col("t"))).alias("_b"),
              F.min(F.when(F.col("t").rlike(PROTECTED_PATTERN), F.col("t"))).alias("_p"))
    base = F.coalesce(F.col("_b"), first)
    other = F.when(base == first, second).otherwise(first)
    return g.select(base.alias("baseline_topic"), F.coalesce(F.col("_p"), other).alias("protected_topic"))


def compare_topics(metrics: DataFrame, baseline: str, protected: str) -> DataFrame:
    """Baseline vs protected totals and reductions (floored at 0); empty when
    the topics are equal or either has no metrics. One conditional aggregate over
    the two topics' rows (a pivot), no join."""
    t = F.coalesce(F.col(TOPIC), F.lit("raw_events"))
    m = metrics.filter(t.isin(baseline, protected))

    def side(topic, col):
        return F.coalesce(F.sum(F.when(t == F.lit(topic), F.col(col))), F.lit(0)).cast("long")

    out = m.agg(
        side(baseline, "raw_events").alias("baseline_raw"),
        side(baseline, "unique_events").alias("baseline_unique"),
        side(baseline, "duplicate_events").alias("baseline_duplicates"),
        side(protected, "raw_events").alias("protected_raw"),
        side(protected, "unique_events").alias("protected_unique"),
        side(protected, "duplicate_events").alias("protected_duplicates"),
        F.count_if(t == F.lit(baseline)).alias("_nb"),
        F.count_if(t == F.lit(protected)).alias("_np"),
    ).filter((F.col("_nb") > 0) & (F.col("_np") > 0) & F.lit(baseline != protected)).drop("_nb", "_np")
    load = F.greatest(F.lit(0), F.col("baseline_raw") - F.col("protected_raw"))
    waste = F.greatest(F.lit(0), F.col("baseline_duplicates") - F.col("protected_duplicates"))

    def pct(num, den):
        return F.when(F.col(den) == 0, F.lit(0.0)).otherwise(
            F.lit(100.0) * num.cast("double") / F.col(den).cast("double"))

    return out.select(
        F.lit(baseline).alias("baseline_topic"), F.lit(protected).alias("protected_topic"), "*",
        load.cast("long").alias("load_reduced"), waste.cast("long").alias("waste_reduced"),
        pct(load, "baseline_raw").alias("load_reduction_pct"),
        pct(waste, "baseline_duplicates").alias("waste_reduction_pct"),
        pct(F.col("protected_raw"), "baseline_raw").alias("protected_load_pct"),
    )


def metrics_with_limits(metrics: DataFrame, limits: DataFrame, mode: str = "radar",
                        policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Metric rows with the client's configured limit in ``mode`` and the adaptive one."""
    lim = limits.select("client_id", F.col("limit_per_minute").cast("string").alias("_stored"))
    out = metrics.join(lim, "client_id", "left")
    return out.withColumn("configured_limit_per_minute", effective_limit(F.lit(mode), F.col("_stored"), policy)) \
        .withColumn("radar_limit_per_minute", effective_limit(F.lit("radar"), F.col("_stored"), policy)) \
        .withColumn("static_limit_per_minute", F.lit(policy.static_limit)).drop("_stored")


def reconcile_offsets(accepted: DataFrame, offsets: DataFrame) -> DataFrame:
    """Accepted count vs messages in the log per topic (full outer), with the difference."""
    a = accepted.select("topic", F.col("accepted").cast("long").alias("accepted"))
    o = offsets.select("topic", F.col("messages").cast("long").alias("messages"))
    out = a.join(o, "topic", "full_outer")
    return out.withColumn("delta", F.coalesce("messages", F.lit(0)) - F.coalesce("accepted", F.lit(0)))


def client_scorecard(counters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accepted, blocked, latest ratio and limit per (client, topic)."""
    d = decisions.select("client_id", F.col("use_case_topic").alias("topic"), "duplicate_ratio",
                         F.col("new_limit_per_minute").alias("adaptive_limit"))
    out = counters.join(d, ["client_id", "topic"], "full_outer")
    return out.select("client_id", "topic",
                      F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"),
                      F.coalesce("blocked", F.lit(0)).cast("long").alias("blocked"),
                      "duplicate_ratio", "adaptive_limit")

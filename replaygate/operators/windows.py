"""Time-windowed views: admission rate, gauge series, latest run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admission_rate(admitted: DataFrame, time_col: str = "event_ts", window: str = "30 seconds",
                   slide: str = "5 seconds", window_s: int = 30) -> DataFrame:
    """Accepted and blocked per second over a trailing window sampled every slide.
    Each event falls in window/slide windows; grouping is by window start."""
    w = F.window(F.col(time_col), window, slide)
    out = admitted.groupBy(w.alias("w")).agg(
        F.count_if(F.col("admitted")).alias("accepted"),
        F.count_if(~F.col("admitted")).alias("blocked"))
    return out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        (F.col("accepted") / F.lit(float(window_s))).alias("accepted_per_s"),
        (F.col("blocked") / F.lit(float(window_s))).alias("blocked_per_s"))


def gauge_series(decisions: DataFrame, slot: str = "1 hour") -> DataFrame:
    """Per (client, topic) and time slot, the last decision's ratio x 100 and limit."""
    s = F.window(F.col("decided_at"), slot).start
    g = decisions.groupBy("client_id", "use_case_topic", s.alias("slot_start")).agg(
        F.max_by(F.col("duplicate_ratio"), F.col("decided_at")).alias("_r"),
        F.max_by(F.col("new_limit_per_minute"), F.col("decided_at")).alias("limit_per_minute"))
    return g.select("client_id", "use_case_topic", "slot_start",
                    (F.col("_r") * F.lit(100.0)).alias("duplicate_ratio_pct"), "limit_per_minute")


def latest_run(runs: DataFrame, by_time: bool = False) -> DataFrame:
    """The latest run per mode: last in topic-name order (or by saved_at)."""
    order = F.desc("saved_at") if by_time else F.desc("topic")
    w = Window.partitionBy("experiment_mode").orderBy(order, F.desc("topic"))
    return runs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")

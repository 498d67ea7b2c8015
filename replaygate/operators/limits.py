"""Limit decisions and lookups (C2 core, W2, J1, J2, F5, A11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import effective_limit, idiv, limit_for_ratio
from ..schema import DEFAULT_POLICY, Policy
from .scan import running_before

#: Seconds of a client's timeline that the as-of join sorts together.
ASOF_BLOCK_S = 3600


def _ts(x) -> Column:
    if x is None:
        return F.lit(None).cast("timestamp")
    if isinstance(x, Column):
        return x
    return F.lit(x).cast("timestamp")


def decide_limits(client_metrics: DataFrame, decided_at=None, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One decision per (topic, client) metrics row: ratio -> tier, valid for the limit TTL.

    ``decided_at``: a timestamp (literal or Column, e.g. the batch time), bound
    by the caller so results are reproducible."""
    at = _ts(decided_at)
    return client_metrics.select(
        "client_id", "use_case_topic", "raw_events", "unique_events", "duplicate_events", "duplicate_ratio",
        limit_for_ratio("duplicate_ratio", policy).alias("new_limit_per_minute"),
        at.alias("decided_at"),
        (at + F.expr(f"INTERVAL {int(policy.limit_ttl_s)} SECONDS")).alias("valid_until"),
    )


def current_limits(decisions: DataFrame, as_of=None, limit_col: str = "new_limit_per_minute") -> DataFrame:
    """Last write wins per client. Decisions are applied in (decided_at, topic)
    order, so within one run a client's limit comes from its greatest topic.
    With ``as_of``, decisions made later or already expired are ignored."""
    d = decisions
    if as_of is not None:
        at = _ts(as_of)
        d = d.filter((F.col("decided_at") <= at) & (F.col("valid_until") > at))
    order = F.struct(F.col("decided_at"), F.col("use_case_topic"))
    return d.groupBy("client_id").agg(
        F.max_by(F.col(limit_col), order).alias("limit_per_minute"),
        F.max_by(F.col("use_case_topic"), order).alias("use_case_topic"),
        F.max_by(F.col("duplicate_ratio"), order).alias("duplicate_ratio"),
        F.max(F.col("decided_at")).alias("decided_at"),
        F.max_by(F.col("valid_until"), order).alias("valid_until"),
    )


def with_limits(events: DataFrame, limits: DataFrame, mode: str = "radar", policy: Policy = DEFAULT_POLICY,
                client_col: str = "client_id", stored_col: str = "limit_per_minute") -> DataFrame:
    """Each event's effective limit from the current-limit table (default when absent,
    floored at the minimum). Plain equi left join: AQE turns it into a broadcast
    join when the limit table is small at run time and keeps a shuffle join
    (with skew splitting) otherwise."""
    lim = limits.select(F.col("client_id").alias(client_col), F.col(stored_col).cast("string").alias("_stored"))
    out = events.join(lim, client_col, "left")
    return out.withColumn("limit_per_minute", effective_limit(F.lit(mode), F.col("_stored"), policy).cast("int")) \
        .drop("_stored")


def with_limits_asof(events: DataFrame, history: DataFrame, time_col: str = "event_ts",
                     client_col: str = "client_id", policy: Policy = DEFAULT_POLICY,
                     limit_col: str = "new_limit_per_minute") -> DataFrame:
    """The limit in force at each event's time: the latest decision with
    decided_at <= t, if t < its valid_until; otherwise the default.

    A sort-merge as-of join: events and decisions are one table of rows, dealt by
    (client, time block) and sorted by time inside it, and every event takes the
    last decision before it. The decision that a block opens with is carried in as a
    row of its own: the last one of the client's earlier blocks, from a running
    maximum over the table of blocks. No event meets more than one decision, and a
    client's timeline is spread over as many tasks as it has blocks.
    """
    known = history.filter(F.col("client_id").isNotNull() & F.col("decided_at").isNotNull()).groupBy("client_id", "decided_at").agg(
        F.max_by(F.col(limit_col), F.col("use_case_topic")).alias("lim"), F.max_by(F.col("valid_until"), F.col("use_case_topic")).alias("until"))
    t, block = F.unix_micros(F.col("_t")), ASOF_BLOCK_S * 1_000_000
    slot = idiv(t - F.pmod(t, F.lit(block)), block)
    decision = F.struct(F.col("decided_at").alias("at"), "lim", "until")
    told = known.select(F.col("client_id").alias("_c"), F.col("decided_at").alias("_t"), decision.alias("_d"), F.lit(0).alias("_kind")).withColumn("_slot", slot)
    asked = events.select(F.col(client_col).alias("_c"), F.col(time_col).alias("_t"), F.struct(*events.columns).alias("_e"), F.lit(1).alias("_kind")).withColumn("_slot", slot)

    blocks = told.groupBy("_c", "_slot").agg(F.max("_d").alias("_d")).unionByName(asked.select("_c", "_slot").distinct(), allowMissingColumns=True)
    blocks = blocks.filter(F.col("_c").isNotNull() & F.col("_slot").isNotNull()).groupBy("_c", "_slot").agg(F.max("_d").alias("_d"), F.max(F.col("_d").isNull()).alias("_asked"))
    opening = running_before(blocks, "_slot", "_d", keys=("_c",), out="_open").filter(F.col("_asked") & F.col("_open").isNotNull())
    opening = opening.select("_c", "_slot", F.col("_open.at").alias("_t"), F.col("_open").alias("_d"), F.lit(0).alias("_kind"))

    both = asked.unionByName(told, allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    last = Window.partitionBy("_c", "_slot").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_d", F.last("_d", ignorenulls=True).over(last)).filter("_kind = 1")
    valid = (F.col("_t") < F.col("_d.until")) & F.col("_c").isNotNull()
    return out.select("_e.*", effective_limit(F.lit("radar"), F.when(valid, F.col("_d.lim")).cast("string"), policy).cast("int").alias("limit_per_minute"),
                      F.when(valid, F.col("_d.at")).alias("decided_at"))


def throttled(decisions: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """decisions below the default limit."""
    return decisions.filter(F.col("new_limit_per_minute") < F.lit(policy.default_limit))


def throttle_count(decisions: DataFrame, policy: Policy = DEFAULT_POLICY, by=("use_case_topic", "client_id")) -> DataFrame:
    """Number of throttling decisions (limit below default), per group."""
    return decisions.groupBy(*by).agg(
        F.count_if(F.col("new_limit_per_minute") < F.lit(policy.default_limit)).alias("throttled_decisions"))

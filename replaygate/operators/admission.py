"""Token-bucket admission (T8), burst admission (W1), admitted/blocked split and counters.

The bucket itself, its exact arithmetic and the chunked plan are in ``bucket``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import effective_limit, idiv
from ..schema import BYPASS_MODES, DEFAULT_POLICY, MAX_REJECTIONS, Policy
from . import bucket
from .bucket import US_PER_S
from .scan import plus, running_before

def token_bucket(df: DataFrame, limit, client_col: str = "client_id", time_col: str = "us",
                 order=("event_id",), mode=None, split_sessions: bool = True, steady: bool | None = None,
                 initial: DataFrame | None = None) -> DataFrame:
    """Adds ``admitted`` (boolean) and ``tokens`` (tokens left after the event).

    ``limit``: an int, or a column name / Column holding each event's limit per
    minute (the limit current at the event's time). ``time_col``: integer
    microseconds. ``order``: tie-breakers after time. ``mode``: None (bucket per
    client), a mode string, or a column name; bypass modes admit everything.
    ``steady``: True where a bucket's limit never changes, which saves a window;
    known for an int. ``initial``: stored buckets (C6: the key columns, tokens,
    last_refill) that the first events of their clients go on from. Without a time
    an event counts as of time 0, without a limit it has the default one.
    ``split_sessions=False`` folds each client serially instead of in chunks.
    """
    lim = F.lit(int(limit)) if isinstance(limit, int) else (F.col(limit) if isinstance(limit, str) else limit)
    steady = isinstance(limit, int) if steady is None else steady
    src = df.withColumn("_lim", F.coalesce(lim.cast("int"), F.lit(DEFAULT_POLICY.default_limit))).withColumn("_us", F.coalesce(F.col(time_col), F.lit(0)).cast("long"))
    key_cols = [client_col]
    bypass = None
    if mode is not None:
        mcol = F.lit(mode) if isinstance(mode, str) and mode not in df.columns else F.col(mode)
        src = src.withColumn("_mode", mcol)
        key_cols = ["_mode", client_col]
        free = F.coalesce(F.col("_mode").isin(*BYPASS_MODES), F.lit(False))  # a NULL mode is no bypass
        bypass = src.filter(free).withColumn("admitted", F.lit(True)).withColumn("tokens", F.lit(None).cast("double"))
        src = src.filter(~free)
        if initial is not None:
            initial = initial.withColumn("_mode", F.col(mode) if isinstance(mode, str) and mode in initial.columns else mcol)
    if split_sessions:
        folded = bucket.fold_in_chunks(src, key_cols, "_us", order, steady, initial)
    elif initial is not None:
        raise ValueError("stored buckets go with the chunked fold")
    else:
        folded = bucket.fold_serially(src, key_cols, "_us", order)
    folded = folded.withColumn("tokens", bucket.to_tokens()).drop("_level")
    if bypass is not None:
        folded = folded.unionByName(bypass)
    return folded.drop("_lim", "_us", "_mode")


def admit(events: DataFrame, mode: str, limits: DataFrame | None = None, policy: Policy = DEFAULT_POLICY,
          client_col: str = "client_id", time_col: str = "us", order=("event_id",)) -> DataFrame:
    """Admission for one experiment mode: the mode's effective limit per client
    (J1 lookup for the adaptive mode), then the bucket."""
    if mode in BYPASS_MODES:
        return events.withColumn("admitted", F.lit(True)).withColumn("tokens", F.lit(None).cast("double")) \
            .withColumn("limit_per_minute", F.lit(policy.default_limit))
    if mode == "static" or limits is None:
        ev = events.withColumn("limit_per_minute", effective_limit(F.lit(mode), F.lit(None).cast("string"), policy))
    else:
        from .limits import with_limits
        ev = with_limits(events, limits, policy=policy, client_col=client_col)
    return token_bucket(ev, "limit_per_minute", client_col=client_col, time_col=time_col, order=order)


def _time_block(df: DataFrame, col: str, block_s: int):
    """Numbered blocks that follow the order of ``col``: time blocks for times and
    microseconds, one block for a column of another type. NULL sorts first."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        block = idiv(F.unix_micros(F.col(col).cast("timestamp")), block_s * US_PER_S)
    elif isinstance(kind, (T.LongType, T.IntegerType)):
        block = F.floor(F.col(col) / F.lit(block_s * US_PER_S)).cast("long")
    else:
        return F.lit(0).cast("long")
    return F.coalesce(block, F.lit(-(1 << 40)).cast("long"))


def admit_burst(events: DataFrame, limit, client_col: str = "client_id", order=("event_ts", "event_id"), block_s: int = 60) -> DataFrame:
    """Zero elapsed time, a full bucket admits the first max(1, floor(limit)) events per client.

    Events are counted per (client, time block); a prefix sum in blocks over that
    table tells for every block whether all, none or some of its events are among
    the first k. Only events of a block of the last kind are ranked, inside it, so
    a hot client is never sorted whole and the limit has no bound. A NULL client
    is a client of its own."""
    lim = F.lit(int(limit)) if isinstance(limit, int) else (F.col(limit) if isinstance(limit, str) else limit)
    ev = events.withColumn("_k", F.greatest(F.lit(1), lim.cast("long"))).withColumn("_block", _time_block(events, order[0], block_s))
    per_block = ev.groupBy(client_col, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_kmin"), F.max("_k").alias("_kmax"))
    per_block = running_before(per_block, "_block", "_n", keys=(client_col,), combine=F.sum, both=plus, out="_earlier")
    before = F.coalesce("_earlier", F.lit(0))
    blocks = per_block.select(F.col(client_col).alias("_c"), F.col("_block").alias("_b"), "_n", "_kmin", "_kmax", before.alias("_before"))
    out = ev.join(blocks, F.col(client_col).eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    every, none = F.col("_before") + F.col("_n") <= F.col("_kmin"), F.col("_before") >= F.col("_kmax")
    sure = out.filter(every | none).withColumn("admitted", every)
    w = Window.partitionBy(client_col, "_block").orderBy(*order)
    rest = out.filter(~(every | none)).withColumn("admitted", F.row_number().over(w) + F.col("_before") <= F.col("_k"))
    return sure.unionByName(rest).drop("_k", "_block", "_c", "_b", "_n", "_kmin", "_kmax", "_before")


def split_admitted(df: DataFrame):
    """(admitted rows, blocked rows)."""
    return df.filter(F.col("admitted")), df.filter(~F.col("admitted"))


def admission_counters(df: DataFrame, client_col: str = "client_id", topic_col: str = "source_topic") -> DataFrame:
    """Accepted / blocked per (client, topic)."""
    return df.groupBy(F.col(client_col).alias("client_id"), F.col(topic_col).alias("topic")).agg(
        F.count_if(F.col("admitted")).alias("accepted"),
        F.count_if(~F.col("admitted")).alias("blocked"),
    )


def ingest_summary(df: DataFrame, topic_col: str = "source_topic", with_rejections: bool = True,
                   order=("us", "event_id")) -> DataFrame:
    """A10: per use-case topic total, accepted, rejected and the first 20 rejections.

    The rejections list is bounded: rows are ranked within the topic's rejected
    rows with a top-k window (cut per partition before the shuffle), so at most
    20 rows per topic reach ``collect_list``."""
    totals = df.groupBy(F.col(topic_col).alias("topic")).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("admitted")).alias("accepted"),
        F.count_if(~F.col("admitted")).alias("rejected"),
    )
    if not with_rejections:
        return totals
    rej = first_rejections(df, topic_col, order)
    lists = rej.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rn", "client_id", "entity_id"))).alias("_r"))
    lists = lists.select("topic", F.transform("_r", lambda x: F.struct(x["client_id"].alias("client_id"),
                                                                      x["entity_id"].alias("entity_id"))).alias("rejections"))
    return totals.join(lists, "topic", "left")


def first_rejections(df: DataFrame, topic_col: str = "source_topic", order=("us", "event_id"),
                     n: int = MAX_REJECTIONS) -> DataFrame:
    """L4: the first n rejected events per topic in arrival order."""
    w = Window.partitionBy("topic").orderBy(*order)
    return (df.filter(~F.col("admitted"))
              .select(F.col(topic_col).alias("topic"), "client_id", "entity_id", *order)
              .withColumn("rn", F.row_number().over(w))
              .filter(F.col("rn") <= F.lit(n))
              .select("topic", "rn", "client_id", "entity_id"))


def upload_gauges(runs: DataFrame) -> DataFrame:
    """Uploads counted; last upload's total / accepted / rejected (last in (saved_at, topic) order)."""
    o = F.struct(F.col("saved_at"), F.col("topic"))
    return runs.agg(
        F.count(F.lit(1)).alias("uploads_total"),
        F.max_by("total_events", o).alias("last_upload_total_events"),
        F.max_by("accepted", o).alias("last_upload_accepted"),
        F.max_by("rejected", o).alias("last_upload_rejected"),
    )


def offset_totals(log: DataFrame) -> DataFrame:
    """Messages per topic from partition offsets: sum over partitions of max - min + 1."""
    per = log.groupBy("topic", "partition").agg((F.max("offset") - F.min("offset") + 1).alias("n"))
    return per.groupBy("topic").agg(F.sum("n").cast("long").alias("messages"),
                                    F.count(F.lit(1)).alias("partitions"))


def offsets_from_map(offsets: DataFrame, col: str = "offsets") -> DataFrame:
    """A13 from a {topic: {partition: offset}} map column (end offsets; start 0)."""
    t = offsets.select(F.explode(F.col(col)).alias("topic", "_p"))
    p = t.select("topic", F.explode("_p").alias("partition", "offset"))
    return p.groupBy("topic").agg(F.sum("offset").cast("long").alias("messages"),
                                  F.count(F.lit(1)).alias("partitions"))

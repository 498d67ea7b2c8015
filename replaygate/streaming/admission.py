"""Streaming token bucket (T8, T9) with live limits, using transformWithStateInPandas.

One keyed state per client holds its buckets, one per mode, and the limit
decisions that still matter. Events and limit decisions are two inputs of the same
state: within a micro-batch a client's rows are taken in time order, decisions
before events of the same time, so every event is admitted under the limit in
force at its own time (the latest decision up to it, while that is valid). The
fold is the batch fold on whole numbers, so a stream split into batches in time
order decides exactly what the batch plan decides.

Buckets can start from stored ones (``initial``), and event-time timers drop
buckets that were idle for the TTL: such a bucket starts full again either way, so
dropping it changes no decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bucket import TOKEN, TTL_US, bucket_fold, to_level
from ..schema import BYPASS_MODES, DEFAULT_POLICY, Policy

_MODE = T.StructType([T.StructField("mode", T.StringType())])
_BUCKET = T.StructType([T.StructField("level", T.LongType()), T.StructField("last", T.LongType())])
_DECISION = T.StructType([T.StructField("decided", T.LongType()), T.StructField("until", T.LongType()), T.StructField("limit", T.LongType())])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Mode under which the bucket of an event without one is kept; a bypass mode has none.
NO_MODE = ""


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session names as its
    provider. A stream takes the settings along when it starts; the session's own come back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class BucketProcessor(StatefulProcessor):
    """State of one client: buckets by mode and the decisions still in question."""

    def __init__(self, in_cols, out_cols, mode_col, limit_col, order, live: bool, timers: bool, policy: Policy):
        self.in_cols, self.out_cols, self.mode_col, self.limit_col = list(in_cols), list(out_cols), mode_col, limit_col
        self.order, self.live, self.timers, self.policy = list(order), live, timers, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", _MODE, _BUCKET)
        self.decisions = handle.getListState("decisions", _DECISION)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for mode, level, last in zip(*(initialState[c].tolist() for c in ("bucket_mode", "bucket_level", "bucket_last"))):
            self.buckets.updateValue((mode,), (int(level), int(last)))
            self._remind(int(last))

    def _remind(self, last: int) -> None:
        """One timer a client: when its buckets may have expired."""
        if self.timers and next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer((last + TTL_US) // 1000 + 1)

    def _limits(self, known, modes, us) -> list[int]:
        p, out, at = self.policy, [], -1
        for mode, now in zip(modes, us):
            while at + 1 < len(known) and known[at + 1][0] <= now:
                at += 1
            if mode == "static":
                out.append(p.static_limit)
            elif at >= 0 and now < known[at][1]:
                out.append(max(p.min_limit, known[at][2]))
            else:
                out.append(p.default_limit)
        return out

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        pdf.columns = self.in_cols  # names that begin with an underscore do not reach Python
        pdf = pdf.sort_values(["_us", *self.order], kind="stable").reset_index(drop=True)
        known = []
        if self.live:
            told = pdf["_decision"].to_numpy(dtype=bool)
            known = [tuple(int(x) for x in d) for d in self.decisions.get()] if self.decisions.exists() else []
            known += list(zip(*(pdf.loc[told, c].astype("int64").tolist() for c in ("_us", "_until", "_limit"))))
            known.sort(key=lambda d: d[0])  # of equal times the later one in the state's order wins
            pdf = pdf[~told].reset_index(drop=True)
        if len(pdf):
            us = pdf["_us"].astype("int64").tolist()
            modes = [NO_MODE if m is None else m for m in pdf[self.mode_col].tolist()] if self.mode_col else [NO_MODE] * len(us)
            limits = self._limits(known, modes, us) if self.live else pdf["_lim"].astype("int64").tolist()
            admitted, tokens = [True] * len(us), [None] * len(us)
            for mode in dict.fromkeys(modes):
                if mode in BYPASS_MODES:
                    continue
                at = [i for i, m in enumerate(modes) if m == mode]
                held = self.buckets.containsKey((mode,)) if self.buckets.exists() else False
                level, last = self.buckets.getValue((mode,)) if held else (0, None)
                a, levels, level, last = bucket_fold([us[i] for i in at], [limits[i] for i in at], level, last)
                self.buckets.updateValue((mode,), (level, last))
                self._remind(last)
                for i, yes, left in zip(at, a, levels):
                    admitted[i], tokens[i] = yes, left / TOKEN
            # decisions replaced before the last event seen are in question no more
            in_force = max([i for i, d in enumerate(known) if d[0] <= us[-1]], default=0)
            known = known[in_force:]
        if self.live and known:
            self.decisions.put(known)
        if len(pdf):
            out = pdf.assign(admitted=admitted, tokens=pd.Series(tokens, dtype="float64"))
            if self.live:
                out[self.limit_col] = limits
            yield out[[*self.out_cols, "admitted", "tokens"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        left = []
        for (mode,), (level, last) in list(self.buckets.iterator()) if self.buckets.exists() else []:
            if now - last >= TTL_US:
                self.buckets.removeKey((mode,))
            else:
                left.append(last)
        if self.decisions.exists():
            valid = [tuple(d) for d in self.decisions.get() if d[1] > now]
            self.decisions.put(valid) if valid else self.decisions.clear()
            left += [d[1] - TTL_US for d in valid]
        if left:
            self.handle.registerTimer((min(left) + TTL_US) // 1000 + 1)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def admit_stream(df: DataFrame, limit_col: str = "limit_per_minute", client_col: str = "client_id", time_col: str = "us",
                 order=("event_id",), mode_col: str | None = None, limits: DataFrame | None = None, initial: DataFrame | None = None,
                 event_time_col: str | None = None, ttl_s: int | None = None, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """T8 on a stream: adds ``admitted`` and ``tokens``; a bucket per (mode, client), bypass modes admit all.

    Without ``limits``, ``limit_col`` holds each event's limit. With ``limits``, a
    stream of decisions (``client_col``, limit_per_minute, decided_us, until_us),
    the limit in force at the event's time is used (J2 and P16) and written to
    ``limit_col``. ``initial``: stored buckets (``client_col``, experiment_mode,
    tokens, last_refill; C6) for the first start of the query. ``event_time_col``:
    a watermarked timestamp of the same clock as ``time_col``; idle buckets are then
    dropped from the state by event time. ``ttl_s`` is taken for compatibility: the
    bucket's TTL is applied by the fold and needs no processing time.

    The state is kept in RocksDB, which the session must name as its provider
    (``state_in_rocksdb``).
    """
    spark = df.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    live = limits is not None
    out_cols = [*df.columns, *([limit_col] if live and limit_col not in df.columns else [])]
    src = df.withColumn("_us", F.coalesce(F.col(time_col), F.lit(0)).cast("long"))
    if live:
        decided = limits.select(
            F.col(client_col), F.col("decided_us").cast("long").alias("_us"), F.col("until_us").cast("long").alias("_until"),
            F.col("limit_per_minute").cast("long").alias("_limit"), F.lit(True).alias("_decision"),
            *([F.timestamp_micros("decided_us").alias(event_time_col)] if event_time_col else []))
        src = src.withColumn("_decision", F.lit(False)).unionByName(decided, allowMissingColumns=True)
    else:
        src = src.withColumn("_lim", F.coalesce(F.col(limit_col), F.lit(policy.default_limit)).cast("long"))
    fields = {f.name: f for f in df.schema.fields} | ({limit_col: T.StructField(limit_col, T.IntegerType())} if live else {})
    out_schema = T.StructType([fields[c] for c in out_cols] + [T.StructField("admitted", T.BooleanType()), T.StructField("tokens", T.DoubleType())])
    held = None
    if initial is not None:
        held = initial.select(client_col, F.coalesce("experiment_mode", F.lit(NO_MODE)).alias("bucket_mode"), to_level("tokens").alias("bucket_level"),
                              F.col("last_refill").cast("long").alias("bucket_last")).groupBy(client_col)
    proc = BucketProcessor(src.columns, out_cols, mode_col, limit_col, order, live, event_time_col is not None, policy)
    return src.groupBy(client_col).transformWithStateInPandas(proc, out_schema, "Append", "EventTime" if event_time_col else "None", held)

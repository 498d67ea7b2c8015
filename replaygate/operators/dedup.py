"""Batch deduplication: keep-first survivors, replay records, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running_before


def _order_struct(order_cols):
    # NULL times sort last: (is_null, value) pairs compare false < true.
    parts = []
    for c in order_cols:
        parts.append(F.col(c).isNull().alias(f"_{c}_null"))
        parts.append(F.col(c).alias(f"_{c}"))
    return F.struct(*parts)


def dedup_keep_first(df: DataFrame, key: str = "dedup_key", order=("event_ts", "event_id")) -> DataFrame:
    """One row per key, the first by ``order`` (a deterministic survivor).

    Planned as a grouped ``min_by`` of the whole row: a partial aggregate runs
    before the shuffle, so a key that holds a third of the input is reduced to
    one row per map task instead of being sorted in a single task, as a
    ``row_number()`` window would do.
    """
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    picked = df.groupBy(key).agg(F.min_by(row, _order_struct(order)).alias("_row"))
    return picked.select("_row.*")


def duplicate_events(df: DataFrame, key: str = "dedup_key", order=("event_ts", "event_id"),
                     id_cols=("event_id",)) -> DataFrame:
    """Replay records, i.e. every row that is not its key's survivor.

    Joined on (key, id): the hash partitioning uses both columns, so rows of a hot
    key spread over all partitions. Replays may carry their original's id; of the
    rows that share the survivor's key and id one is the survivor, and the others
    are numbered and kept as replays."""
    keep = dedup_keep_first(df.select(key, *order, *[c for c in id_cols if c not in order]), key, order)
    on = [key, *id_cols]
    keep = keep.select(*[F.col(c).alias(f"_keep_{c}") for c in on], F.lit(True).alias("_kept"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_keep_{c}"))
    marked = df.join(keep, same, "left").drop(*[f"_keep_{c}" for c in on])
    w = Window.partitionBy(*on).orderBy(*order)
    again = marked.filter("_kept").withColumn("_rn", F.row_number().over(w)).filter("_rn > 1").drop("_rn")
    return marked.filter("_kept IS NULL").unionByName(again).drop("_kept")


def late_events(df: DataFrame, delay: str = "10 minutes", batch_col: str = "batch_id",
                time_col: str = "event_ts") -> DataFrame:
    """T4 (batch form): rows a streaming watermark would drop.

    The watermark used by batch N is the largest event time of batches before N
    minus ``delay``; a row is late when its event time is older. NULL times are
    never late. The per-batch maxima form a small table (one row per batch), a
    running maximum in blocks goes over it, and events join it on the batch number.
    """
    per_batch = df.filter(F.col(batch_col).isNotNull()).groupBy(batch_col).agg(F.max(time_col).alias("_bmax"))
    marks = running_before(per_batch, batch_col, "_bmax", out="_until")
    marks = marks.select(batch_col, (F.col("_until") - F.expr(f"INTERVAL {delay}")).alias("watermark"))
    out = df.join(marks, batch_col, "left")
    return out.filter(F.col(time_col).isNotNull() & F.col("watermark").isNotNull()
                      & (F.col(time_col) < F.col("watermark")))

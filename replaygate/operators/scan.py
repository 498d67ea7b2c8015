"""A running total or maximum over a long ordered table without a window over all of it.

Rows are cut into blocks of consecutive numbers. One window runs inside each block,
one over the block totals (a few thousandths of the rows), and each block starts
from what the totals before it carry in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import idiv
from .bucket import bucket_key

BLOCK = 4096


def running_before(rows: DataFrame, index: str, value: str, keys=(), combine: Callable[[Column], Column] = F.max,
                   both: Callable[[Column, Column], Column] = F.greatest, block: int = BLOCK, out: str = "before") -> DataFrame:
    """`rows` with `out`: `combine` of `value` over the rows of the same `keys` with a
    smaller `index` (a long); NULL where there is none. `both` combines two such
    results, and must pass over a NULL as `greatest` does. NULL keys are a key."""
    at = F.col(index)
    rows = rows.withColumn("_scan_key", bucket_key(keys) if keys else F.lit("")).withColumn("_scan_block", idiv(at - F.pmod(at, F.lit(block)), block))

    def before(*parts):
        return Window.partitionBy(*parts).orderBy(index if "_scan_block" in parts else "_scan_block").rangeBetween(Window.unboundedPreceding, -1)

    totals = rows.groupBy("_scan_key", "_scan_block").agg(combine(F.col(value)).alias("_total"))
    carried = totals.select(F.col("_scan_key").alias("_of"), F.col("_scan_block").alias("_at"), combine(F.col("_total")).over(before("_scan_key")).alias("_carried"))
    inside = rows.withColumn("_inside", combine(F.col(value)).over(before("_scan_key", "_scan_block")))
    joined = inside.join(carried, (F.col("_scan_key") == F.col("_of")) & (F.col("_scan_block") == F.col("_at")), "left")
    return joined.withColumn(out, both(F.col("_carried"), F.col("_inside"))).drop("_scan_key", "_scan_block", "_of", "_at", "_carried", "_inside")


def plus(a: Column, b: Column) -> Column:
    """Sum of two running sums, NULL only if both are."""
    return F.when(a.isNull() & b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

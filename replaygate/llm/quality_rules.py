"""Quality rules with adaptive thresholds (operator 2).

Each language and source gets its own limits, read from mergeable quantile
sketches instead of fixed cutoffs, and documents are filtered by a join with
them. The sketch is a histogram over logarithmic buckets (relative error ALPHA):
two sketches merge by adding counts, so it is a plain two-phase aggregate,
does not depend on row order, and holds a bounded number of rows per group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .words import coded_words, documents, row_sums, slices, stored, unburdened

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Relative error of a sketch's quantiles; values below SMALLEST share bucket 0.
ALPHA, SMALLEST = 0.01, 1e-6
#: A fence lies SPREADS times the spread (third less first quartile) beyond the
#: quartile; a metric's spread counts as at least the value given here, so that a
#: group where nearly all documents are alike doesn't reject the next-best ones.
SPREADS = 3.0
METRICS = {"symbols_per_word": 0.1, "upper_share": 0.1, "chars_per_word": 1.0, "dup_line_share": 0.15, "repeat_share": 0.1}
TWO_SIDED = ("chars_per_word",)
#: A group with fewer documents than this takes its language's merged sketch, else that of all.
MIN_GROUP = 100

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def repeated_window_words(codes: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row, the words inside a `window`-word run that occurs twice or more in
    that row. Runs are compared exactly: equal runs get equal numbers, doubling
    the length of what a number stands for."""
    n = len(codes)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ids, span = codes, 1
    while span < window:
        step = min(span, window - span)
        top = int(ids.max()) + 1 if len(ids) else 1
        if len(ids) <= step:
            return np.zeros(len(off) - 1, np.int64)
        _, ids = np.unique(ids[: len(ids) - step] * top + ids[step:], return_inverse=True)
        span += step
    starts = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])  # runs inside one row
    _, back, count = np.unique(ids[starts] * len(off) + owner[starts], return_inverse=True, return_counts=True)
    hit = starts[count[back] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return row_sums(np.cumsum(cover[:-1]) > 0, off)


def _line_stats(texts: list) -> tuple[list[int], list[int]]:
    total, dup = [], []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        total.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    return total, dup


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts over each whole text (a null text counts as empty: all 0)."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(k).cast("string").alias(f"group_{k}") for k in keep))

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                off, codes, words = coded_words(texts)
                chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                lines, dup = _line_stats(texts.to_pylist())
                cols = [np.diff(off), row_sums(chars[codes], off), pc.count_substring_regex(texts, r"[#*$%&|<>]"), dup,
                        repeated_window_words(codes, off), lines, pc.count_substring_regex(texts, r"\p{Lu}")]
                cols = [pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c.cast(pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(f"group_{k}") for k in keep), *cols], names=names)

    names = ["id", *(f"group_{k}" for k in keep), *(c.split()[0] for c in BASE.split(", "))]
    groups = "".join(f"group_{k} string, " for k in keep)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {groups}{BASE}")


def _metrics(df: DataFrame) -> DataFrame:
    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return (df.withColumn("symbols_per_word", share("n_symbols", "n_words")).withColumn("upper_share", share("n_upper", "word_chars"))
            .withColumn("chars_per_word", share("word_chars", "n_words")).withColumn("dup_line_share", share("n_dup_lines", "n_lines"))
            .withColumn("repeat_share", share("n_repeat_words", "n_words")))


def sketch(df: DataFrame, keys: list[str], metrics) -> DataFrame:
    """(keys, metric, bucket, n): the mergeable sketch of every metric and group."""
    gamma = math.log((1 + ALPHA) / (1 - ALPHA))
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m"))
    offset = math.ceil(math.log(SMALLEST) / gamma) - 1
    bucket = F.when(F.col("m.value") < SMALLEST, 0).otherwise(F.ceil(F.log(F.col("m.value")) / gamma) - offset).cast("int")
    return long.groupBy(*keys, F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, q1, q3) read from sketches; a group's window holds its buckets only."""
    gamma = math.log((1 + ALPHA) / (1 - ALPHA))
    offset = math.ceil(math.log(SMALLEST) / gamma) - 1
    w = W.partitionBy(*keys, "metric")
    at = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))

    def quantile(q):
        b = F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("bucket")))
        return F.when(b == 0, 0.0).otherwise(F.exp((b + offset) * gamma) * (1 - ALPHA))
    return at.groupBy(*keys, "metric").agg(F.max("total").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def limits(measured: DataFrame, keys: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """One row per group with <metric>_low and <metric>_high. `keys` go from the
    coarsest to the finest; a small group takes the sketch merged over the finer key."""
    levels = [sketch(measured, keys, METRICS)]
    for i in range(len(keys) - 1, -1, -1):
        levels.append(merge(levels[-1], keys[:i]))
    found = quartiles(levels[0], keys)
    for i, level in enumerate(levels[1:]):
        at = keys[: len(keys) - 1 - i]
        up = quartiles(level, at).select(*(F.col(k).alias(f"up_{k}") for k in at), F.col("metric").alias("up_metric"), F.col("n").alias("up_n"), F.col("q1").alias("up_q1"), F.col("q3").alias("up_q3"))
        on = F.col("metric") == F.col("up_metric")
        for k in at:
            on = on & F.col(k).eqNullSafe(F.col(f"up_{k}"))
        small = F.col("n") < min_group
        found = found.join(up, on, "left").select(*keys, "metric", *(F.when(small, F.col(f"up_{c}")).otherwise(F.col(c)).alias(c) for c in ("n", "q1", "q3")))
    least = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))[F.col("metric")]
    reach = SPREADS * F.greatest(F.col("q3") - F.col("q1"), least)
    fenced = found.withColumn("low", F.when(F.col("metric").isin(*TWO_SIDED), F.col("q1") - reach)).withColumn("high", F.col("q3") + reach)
    return fenced.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")))


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), min_group: int = MIN_GROUP) -> DataFrame:
    """(id, base counts, base_failed, kept, ...) of every row of `df`.

    Sketches hold the documents that pass the base rules. A null key is a group of
    its own. Null, empty and word-less texts fail the base rules; repeated rows
    each count and each get a row; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = stored(_metrics(measure(df, id_col, text_col, keys)).withColumn("base_failed", failed), "measured")
    groups = [f"group_{k}" for k in keys]
    bounds = stored(limits(measured.filter(~F.col("base_failed")), groups, min_group), "limits")
    bounds = bounds.select(*(F.col(g).alias(f"of_{g}") for g in groups), *(c for c in bounds.columns if c not in groups))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
        if m in TWO_SIDED:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    out = measured.join(bounds, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))

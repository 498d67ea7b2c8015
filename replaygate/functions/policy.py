"""Ratio, limit, label and presentation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BYPASS_MODES, DEFAULT_POLICY, Policy


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dup_ratio(duplicates, raw) -> Column:
    """duplicates / raw, 0.0 when raw is 0 (bare division raises under ANSI)."""
    raw = _c(raw)
    return F.when(raw == 0, F.lit(0.0)).otherwise(_c(duplicates).cast("double") / raw.cast("double"))


def limit_for_ratio(ratio, policy: Policy = DEFAULT_POLICY) -> Column:
    """Tier for a duplicate ratio: clamp to [0, 1], then half-open cuts (exactly 0.70 -> min)."""
    risk = F.least(F.greatest(_c(ratio).cast("double"), F.lit(0.0)), F.lit(1.0))
    out = None
    for cut, lim in policy.tiers:
        cond = risk < F.lit(float(cut))
        out = F.when(cond, F.lit(int(lim))) if out is None else out.when(cond, F.lit(int(lim)))
    return out.otherwise(F.lit(int(policy.min_limit)))


def effective_limit(mode, stored, policy: Policy = DEFAULT_POLICY) -> Column:
    """Limit a bucket runs at: bypass modes nominal default, static fixed, adaptive
    max(min, stored) or the default when nothing is stored. Decimal text truncates."""
    mode = _c(mode)
    stored = _c(stored)
    stored_int = stored.try_cast("double").try_cast("int") if stored is not None else None
    adaptive = F.when(stored_int.isNull(), F.lit(policy.default_limit)).otherwise(
        F.greatest(F.lit(policy.min_limit), stored_int))
    return (F.when(mode.isin(*BYPASS_MODES), F.lit(policy.default_limit))
            .when(mode == "static", F.lit(policy.static_limit))
            .otherwise(adaptive))


def strategy_label(mode, per_upload: bool = False) -> Column:
    mode = _c(mode)
    bypass = "bypass" if per_upload else "bypass_rate_limit"
    return (F.when(mode.isin(*BYPASS_MODES), F.lit(bypass))
            .when(mode == "static", F.lit("static_token_bucket"))
            .otherwise(F.lit("radar_adaptive_token_bucket")))


def health_label(ratio) -> Column:
    r = to_number(ratio)
    return (F.when(r >= 0.5, F.lit("Replay risk"))
            .when(r >= 0.15, F.lit("Watch"))
            .otherwise(F.lit("Healthy")))


def to_number(col) -> Column:
    """Numeric value or 0 for non-numeric, NaN or infinite input; a type suffix as in '5d' is not numeric."""
    text = _c(col).cast("string")
    v = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def as_percent(ratio, scale: float = 100.0) -> Column:
    """'12.3%' from a ratio (scale 100) or from a percentage (scale 1)."""
    return F.format_string("%.1f%%", to_number(ratio) * F.lit(scale))


def round_half_even(col, digits: int) -> Column:
    """Python's round() is half-even; bround matches it."""
    return F.bround(_c(col), digits)


def idiv(a, b) -> Column:
    """Integral division (SQL ``div``): exact on longs, unlike floor(a / b) through doubles."""
    return F.call_function("div", _c(a), b if isinstance(b, Column) else F.lit(b))


def percent_text(num, den) -> Column:
    """'12.3%' for 100 * num / den, rounded to one decimal, ties up, exactly (integers);
    '0.0%' when den is 0."""
    n, d = _c(num).cast("long"), _c(den).cast("long")
    tenths = idiv(n * F.lit(2000) + d, d * F.lit(2))
    tenths = F.when(d == 0, F.lit(0).cast("long")).otherwise(tenths)
    return F.concat(idiv(tenths, 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))

"""String expressions: topic names, modes, payload text, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MODES, TOPIC_BAD_CHARS, TOPIC_FALLBACK, TOPIC_MAX_CHARS, TOPIC_PREFIX, UPLOAD_FALLBACK_NAME


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col) -> Column:
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def topic_name(name) -> Column:
    """Use-case topic: trim, lower, runs of disallowed characters -> '_', strip '_',
    empty -> fallback, first 80 characters, prefixed."""
    s = F.lower(strip_ws(name))
    s = F.regexp_replace(s, TOPIC_BAD_CHARS, "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    s = F.when(s == "", F.lit(TOPIC_FALLBACK)).otherwise(s)
    return F.concat(F.lit(TOPIC_PREFIX), F.substring(s, 1, TOPIC_MAX_CHARS))


def normalize_mode(mode, default: str = "radar") -> Column:
    """NULL or empty -> default; otherwise trimmed and lower-cased. Unknown values
    (including whitespace-only) come out NULL; see ``mode_is_valid``."""
    raw = _c(mode)
    s = F.lower(strip_ws(F.coalesce(F.nullif(raw, F.lit("")), F.lit(default))))
    return F.when(s.isin(*MODES), s)


def mode_is_valid(mode, default: str = "radar") -> Column:
    return normalize_mode(mode, default).isNotNull()


def parse_payload(text) -> Column:
    """Payload text -> map<string,string>. Empty -> {}, unparsable or not an object -> {value: text}."""
    t = _c(text)
    parsed = F.from_json(t, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return (F.when(t.isNull() | (t == ""), empty)
            .when(parsed.isNull(), F.create_map(F.lit("value"), t))
            .otherwise(parsed))


def use_case_from_path(path) -> Column:
    """File name without its extension; empty -> 'Uploaded Use Case'."""
    base = F.regexp_extract(_c(path), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    return F.when(stem == "", F.lit(UPLOAD_FALLBACK_NAME)).otherwise(stem)

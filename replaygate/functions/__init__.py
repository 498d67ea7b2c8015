"""Column expressions (built-in Spark functions only; all stay inside codegen)."""

from .keys import DEDUP_KEY_COLS, dedup_key, with_dedup_key
from .policy import (as_percent, dup_ratio, effective_limit, health_label, idiv, limit_for_ratio, percent_text,
                     round_half_even, strategy_label, to_number)
from .text import mode_is_valid, normalize_mode, parse_payload, topic_name, use_case_from_path

__all__ = [
    "DEDUP_KEY_COLS", "dedup_key", "with_dedup_key", "as_percent", "dup_ratio", "effective_limit",
    "health_label", "idiv", "limit_for_ratio", "percent_text", "round_half_even", "strategy_label", "to_number",
    "mode_is_valid", "normalize_mode", "parse_payload", "topic_name", "use_case_from_path",
]

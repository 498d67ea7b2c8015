"""DataFrame -> DataFrame operators. None of them collects to the driver."""

from . import admission, dedup, enrich, filters, joins, limits, metrics, windows  # noqa: F401

"""Numeric expressions: exact rounded shares and unrounded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money totals are cut to 20 whole digits before a division so that the quotient keeps 12 decimals.
_MONEY = "decimal(22,2)"
_COUNT = "decimal(18,0)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonzero(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(0))


def money_share(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part * 100 / whole`` of two money amounts, rounded half up; null when whole is 0."""
    part, whole = _col(part).cast(_MONEY), _col(whole).cast(_MONEY)
    return F.round(part * 100 / nonzero(whole), digits)


def count_share(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part * 100 / whole`` of two counts, rounded half up; null when whole is 0."""
    part, whole = _col(part).cast(_COUNT), _col(whole).cast(_COUNT)
    return F.round(part * 100 / nonzero(whole), digits)


def ratio_percent(part: Column | str, whole: Column | str) -> Column:
    """``part * 100 / whole`` as an unrounded double; null when whole is 0."""
    part, whole = _col(part).cast("double"), _col(whole).cast("double")
    return part * 100.0 / nonzero(whole)


def money_mean(total: Column | str, n: Column | str) -> Column:
    """Mean of money amounts with six decimals, from their total and number."""
    return (_col(total).cast(_MONEY) / nonzero(_col(n).cast(_COUNT))).cast("decimal(22,6)")

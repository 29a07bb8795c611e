"""Row predicates and row flags."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.functions import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_true(flag: Column | str) -> Column:
    """A three-valued flag as two-valued: null counts as false."""
    return F.coalesce(_col(flag), F.lit(False))


def not_suspicious(flag: Column | str = "fl_valor_suspeito") -> Column:
    return ~is_true(flag)


def real_process(number: Column | str = "nu_processo") -> Column:
    """Keeps process numbers with a digit other than zero; null, blank and text-only ones go."""
    return F.coalesce(_col(number).rlike("[1-9]"), F.lit(False))


def amended(
    value: Column | str = "vl_aditado", days: Column | str = "dias_aditados"
) -> Column:
    return (_col(value) > 0) | (_col(days) > 0)


def not_test(
    text: Column | str = "ds_objeto",
    value: Column | str = "vl_original",
    max_test_value: float = rules.TEST_MAX_VALUE,
) -> Column:
    """Drops test records and those at or below the test value; an unknown object goes too."""
    lowered = F.lower(_col(text))
    return (
        ~lowered.isin(*rules.TEST_OBJECTS)
        & (F.trim(lowered) != rules.TEST_OBJECTS[0])
        & (_col(value) > max_test_value)
    )


def amendment_inconsistent(
    amended_value: Column | str = "vl_aditado", change: Column | str = "vl_variacao"
) -> Column:
    """True when a reported amendment departs from the change of value; null without amendment."""
    amended_value, change = _col(amended_value), _col(change)
    apart = F.abs(change - amended_value) > F.lit(contract.AMENDMENT_TOLERANCE)
    return F.when(amended_value != 0, F.coalesce(apart, F.lit(False)))


def suspicious_value(
    original: Column | str = "vl_original",
    current: Column | str = "vl_atual",
    number: Column | str = "nu_contrato",
    confirmed: Iterable[str] = contract.SUSPICIOUS_CONTRACTS,
    ratio_limit: float = contract.SUSPICIOUS_RATIO,
    value_limit=contract.SUSPICIOUS_VALUE,
) -> Column:
    """True for implausible values: original far above current, a huge current value apart from
    the original, or a number on the confirmed list; null when a value is missing."""
    original, current = _col(original), _col(current)
    ratio = original / F.nullif(current, F.lit(0))
    apart = F.abs(ratio - 1) >= F.lit(contract.SUSPICIOUS_TOLERANCE)
    listed = _col(number).isin(*confirmed)
    flagged = is_true(ratio > ratio_limit) | is_true((current > value_limit) & apart) | is_true(listed)
    return F.when(original.isNotNull() & current.isNotNull(), flagged)


def equals_given(**wanted) -> Column:
    """All given (non-None) ``column=value`` conditions together; true when none is given."""
    conditions = [F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

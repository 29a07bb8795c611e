"""Label columns built from the rule lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_sign(value: Column | str, labels: tuple[str, str, str], null_as_zero: bool = False) -> Column:
    """Label a number by its sign; a null stays null unless ``null_as_zero``."""
    value = _col(value)
    negative, zero, positive = labels
    label = F.when(value < 0, negative).when(value > 0, positive)
    return label.otherwise(zero) if null_as_zero else label.when(value == 0, zero)


def by_band(value: Column | str, bands: list[tuple[int, str]], rest: str) -> Column:
    """Label of the highest band whose lower limit the value reaches."""
    value = _col(value)
    label = reduce(lambda acc, b: acc.when(value >= b[0], b[1]), bands, F)
    return label.otherwise(rest)


def normalize_modality(modality: Column | str) -> Column:
    """Common label for the law variants of one modality; null gets its own label."""
    modality = _col(modality)
    merged = reduce(
        lambda acc, item: acc.when(modality.isin(item[1]), item[0]),
        rules.MODALITY_LABELS.items(),
        F,
    )
    return merged.otherwise(F.coalesce(modality, F.lit(rules.MODALITY_MISSING)))


def _needed_keywords(words: list[str]) -> list[str]:
    """Drop keywords that hold a shorter keyword of the same rule: they can add no match."""
    return [w for w in words if "+" in w or not any(o != w and o in w for o in words)]


def classify_branch(lowered: Column | str, branch_rules: dict[str, list[str]]) -> Column:
    """First rule with a keyword inside the (already lower-cased) object text."""
    lowered = _col(lowered)

    def holds(word: str) -> Column:
        parts = [lowered.contains(p.strip()) for p in word.split("+")]
        return reduce(lambda a, b: a & b, parts)

    label = F
    for name, words in branch_rules.items():
        label = label.when(reduce(lambda a, b: a | b, map(holds, _needed_keywords(words))), name)
    return label.otherwise(rules.BRANCH_OTHER)


def classify_supplier_id(supplier: Column | str) -> Column:
    """Masked person id, company id, or neither."""
    supplier = _col(supplier)
    return (
        F.when(supplier.rlike(rules.SUPPLIER_PERSON_PATTERN), rules.SUPPLIER_PERSON)
        .when(supplier.rlike(rules.SUPPLIER_COMPANY_PATTERN), rules.SUPPLIER_COMPANY)
        .otherwise(rules.SUPPLIER_UNKNOWN)
    )


def supplier_size(total: Column | str) -> Column:
    return by_band(total, rules.SUPPLIER_SIZE_BANDS, rules.SUPPLIER_SIZE_REST)


def agency_volume(contracts: Column | str) -> Column:
    return by_band(contracts, rules.AGENCY_VOLUME_BANDS, rules.AGENCY_VOLUME_REST)


def amendment_status(amended: Column | str) -> Column:
    return by_sign(amended, rules.AMENDMENT_STATUS)


def total_change(change: Column | str) -> Column:
    return by_sign(change, rules.TOTAL_CHANGE)


def value_change(change: Column | str) -> Column:
    return by_sign(change, rules.VALUE_CHANGE, null_as_zero=True)


def term_change(days: Column | str) -> Column:
    return by_sign(days, rules.TERM_CHANGE, null_as_zero=True)


def amendment_direction(change: Column | str) -> Column:
    return by_sign(change, rules.AMENDMENT_DIRECTION, null_as_zero=True)


def amendment_type(amended: Column | str, days: Column | str) -> Column:
    """What an amendment touched; an unknown term with an amended value counts as no change."""
    amended, days = _col(amended), _col(days)
    return (
        F.when((amended > 0) & (days > 0), rules.AMENDMENT_BOTH)
        .when((amended > 0) & (days == 0), rules.AMENDMENT_VALUE)
        .when((amended == 0) & (days > 0), rules.AMENDMENT_TERM)
        .otherwise(rules.AMENDMENT_NONE)
    )


def variation_band(percent: Column | str) -> Column:
    percent = _col(percent)
    return (
        F.when(percent > rules.BAND_LIMIT, rules.BAND_ABOVE)
        .when(percent > 0, rules.BAND_UP_TO)
        .otherwise(rules.BAND_NONE)
    )


def diversity(suppliers: Column | str) -> Column:
    suppliers = _col(suppliers)
    return F.when(suppliers == 1, rules.DIVERSITY_SINGLE).when(
        suppliers > 1, rules.DIVERSITY_MULTIPLE
    )

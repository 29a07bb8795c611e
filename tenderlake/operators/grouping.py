"""Grouped summaries that stay safe when one key holds a large part of all rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import measures as M


class Measure(NamedTuple):
    """One output of a summary: ``sum``, ``mean``, ``max``, ``min``, ``rows`` or ``rows_where``."""

    kind: str
    source: Column | str | None = None
    zero_if_null: bool = False


def rows() -> Measure:
    return Measure("rows")


def rows_where(condition: Column) -> Measure:
    return Measure("rows_where", condition)


def total(column: str, zero_if_null: bool = True) -> Measure:
    return Measure("sum", column, zero_if_null)


def mean(column: str) -> Measure:
    return Measure("mean", column, True)


def largest(column: str, zero_if_null: bool = True) -> Measure:
    return Measure("max", column, zero_if_null)


def smallest(column: str, zero_if_null: bool = True) -> Measure:
    return Measure("min", column, zero_if_null)


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_pass(name: str, m: Measure) -> dict[str, Column]:
    """Partial results of a measure over the rows of one group."""
    if m.kind == "rows":
        return {name: F.count(F.lit(1))}
    source = _as_column(m.source)
    if m.kind == "rows_where":
        return {name: F.count_if(source)}
    if m.kind == "mean":
        return {f"{name}__sum": F.sum(source), f"{name}__n": F.count(source)}
    return {name: {"sum": F.sum, "max": F.max, "min": F.min}[m.kind](source)}


def _second_pass(name: str, m: Measure) -> dict[str, Column]:
    """Combines partial results."""
    if m.kind == "mean":
        return {n: F.sum(n) for n in (f"{name}__sum", f"{name}__n")}
    return {name: {"max": F.max, "min": F.min}.get(m.kind, F.sum)(name)}


def _finish(name: str, m: Measure) -> Column:
    out = M.money_mean(f"{name}__sum", f"{name}__n") if m.kind == "mean" else F.col(name)
    return (F.coalesce(out, F.lit(0)) if m.zero_if_null else out).alias(name)


def summarize(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, Measure],
    distinct: dict[str, str] | None = None,
    modes: dict[str, str] | None = None,
) -> DataFrame:
    """Measures, distinct counts and most frequent values per group, nulls ignored by both.

    A tie for the most frequent value goes to the lowest one. Distinct counts and modes are taken
    over (group, value) pairs that are counted first, so a hot group is spread by its values and
    no task holds all values of a group.
    """
    distinct, modes = distinct or {}, modes or {}
    if not modes:
        partial = {k: c for n, m in measures.items() for k, c in _first_pass(n, m).items()}
        grouped = df.groupBy(*keys).agg(
            *[c.alias(n) for n, c in partial.items()],
            *[F.count_distinct(F.col(source)).alias(n) for n, source in distinct.items()],
        )
    else:
        grouped = _summarize_by_value(df, keys, measures, distinct, modes)
    return grouped.select(
        *keys,
        *modes,
        *[_finish(n, m) for n, m in measures.items()],
        *distinct,
    )


def _summarize_by_value(df, keys, measures, distinct, modes) -> DataFrame:
    facets = [*modes.items(), *distinct.items()]
    # Each row is read once per facet; only the copy of facet 0 carries the measured columns.
    copies = df.withColumn(
        "_facet",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("id"), F.col(source).cast("string").alias("value"))
                    for i, (_, source) in enumerate(facets)
                ]
            )
        ),
    ).withColumns({"_id": F.col("_facet.id"), "_value": F.col("_facet.value")})
    main = F.col("_id") == 0

    def only_main(m: Measure) -> Measure:
        if m.kind == "rows":
            return m
        if m.kind == "rows_where":
            return m._replace(source=main & m.source)
        return m._replace(source=F.when(main, _as_column(m.source)))

    partial = {k: c for n, m in measures.items() for k, c in _first_pass(n, only_main(m)).items()}
    by_value = copies.groupBy(*keys, "_id", "_value").agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in partial.items()]
    )
    combined = {
        k: c
        for n, m in measures.items()
        for k, c in (
            {n: F.sum(F.when(main, F.col(n)))} if m.kind == "rows" else _second_pass(n, m)
        ).items()
    }
    present = F.col("_value").isNotNull()
    tops = []
    counts = []
    for i, (name, _) in enumerate(facets):
        here = present & (F.col("_id") == i)
        if name in modes:
            order = F.struct(-F.col("_n"), F.col("_value"))
            tops.append(F.min_by("_value", F.when(here, order)).alias(name))
        else:
            counts.append(F.count_if(here).alias(name))
    return by_value.groupBy(*keys).agg(*[c.alias(n) for n, c in combined.items()], *tops, *counts)

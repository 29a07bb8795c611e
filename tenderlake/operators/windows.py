"""Calendar windows over aggregates; every window group is bounded by the number of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total_year(
    df: DataFrame,
    totals: dict[str, str],
    year: str = "ano_assinatura",
    month: str = "mes_assinatura",
) -> DataFrame:
    """Add ``name: value`` running totals over the months of each year."""
    window = Window.partitionBy(year).orderBy(month)
    return df.withColumns({name: F.sum(value).over(window) for name, value in totals.items()})


def lag_year_guarded(
    df: DataFrame,
    value: str,
    keys: list[str],
    previous: str,
    change: str,
    percent: str,
    year: str = "ano_assinatura",
) -> DataFrame:
    """Add the value one year earlier, the change and its percent.

    They are set only when the preceding row of the series is the year before; a gap gives null.
    """
    window = Window.partitionBy(*keys).orderBy(year)
    adjacent = F.lag(year).over(window) == F.col(year) - 1
    moved = F.col(value) - F.col(previous)
    return df.withColumn(previous, F.when(adjacent, F.lag(value).over(window))).withColumns(
        {
            change: moved,
            percent: F.round(
                moved.cast("decimal(22,2)")
                * 100
                / F.nullif(F.col(previous), F.lit(0)).cast("decimal(22,2)"),
                2,
            ),
        }
    )


def moving_avg_3y(
    df: DataFrame, value: str, keys: list[str], name: str, year: str = "ano_assinatura"
) -> DataFrame:
    """Add the mean over the calendar range of this year and the two before, rounded to cents."""
    window = Window.partitionBy(*keys).orderBy(year).rangeBetween(-2, 0)
    total = F.sum(value).over(window).cast("decimal(22,2)")
    return df.withColumn(name, F.round(total / F.count(value).over(window), 2))

"""Ranks, shares of a total and exact percentiles without ever sorting all rows in one task.

A rank needs, for each value, the number of rows that come before it. Equal values are counted
together first, so a value that many rows share is one row. The counted values are then cut into
ranges of about equal size and written once with the number of their range; each range is sorted by
its own task, and only the sizes of the ranges are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import measures as M
from tenderlake.session import SMALL_ROWS, materialize


def rows_before(
    df: DataFrame, value: str, partition: list[str] | None = None, descending: bool = True
) -> DataFrame:
    """One row per distinct value (per partition): ``_n`` rows hold it, ``_before`` precede it.

    Descending order puts nulls first, ascending order puts them last.
    """
    keys = partition or []
    order = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_last()
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # Range limits are sampled, so they may differ from one evaluation to the next; writing the
    # number of the range with the row settles it for everything below.
    ranged, _ = materialize(
        counted.repartitionByRange(*[F.col(k).asc() for k in keys], order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    earlier = (Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_range_n"))
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_range").alias("_offset_range"),
            F.coalesce(
                F.sum("_range_n").over(
                    Window.partitionBy(*keys).orderBy("_range").rowsBetween(*earlier)
                ),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    inside = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(*earlier)),
        F.lit(0),
    )
    same = F.col("_range") == F.col("_offset_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # Without a partition there is one offset per shuffle partition, so they may be sent whole.
    offsets = offsets if keys else F.broadcast(offsets)
    return ranged.withColumn("_inside", inside).join(offsets, same).select(
        *keys, value, "_n", (F.col("_offset") + F.col("_inside")).alias("_before")
    )


def rank_in_one_task(df: DataFrame, name: str, value: str, partition: list[str] | None = None):
    window = Window.partitionBy(*(partition or [])).orderBy(F.col(value).desc_nulls_first())
    return df.withColumn(name, F.rank().over(window).cast("long"))


def rank_by_counting(df: DataFrame, name: str, value: str, partition: list[str] | None = None):
    """The same rank from ``rows_before``, joined back on the value."""
    keys = partition or []
    before = rows_before(df, value, keys).select(
        *[F.col(k).alias(f"_rank_{k}") for k in keys],
        F.col(value).alias("_rank_value"),
        (F.col("_before") + 1).cast("long").alias(name),
    )
    same = F.col(value).eqNullSafe(F.col("_rank_value"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_{k}"))
    return df.join(before, same, "left").select(*df.columns, name)


def with_ranks(
    df: DataFrame,
    ranks: dict[str, str],
    partition: list[str] | None = None,
    rows: int | None = None,
    one_task_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``name: value`` ranks, highest value first, ties sharing a rank.

    ``df`` is an aggregate; it is materialized unless its row count is given. A counted, small
    aggregate is ranked by a plain window, a larger one by counting.
    """
    if rows is None:
        df, rows = materialize(df)
    step = rank_in_one_task if rows <= one_task_rows else rank_by_counting
    for name, value in ranks.items():
        df = step(df, name, value, partition)
    return df


def rank_global(df: DataFrame, name: str, value: str, **options) -> DataFrame:
    return with_ranks(df, {name: value}, **options)


def rank_partitioned(
    df: DataFrame, name: str, value: str, partition: list[str], **options
) -> DataFrame:
    return with_ranks(df, {name: value}, partition, **options)


def with_total(df: DataFrame, name: str, value: str) -> DataFrame:
    """Add the sum of a column over all rows, computed once as a scalar subquery."""
    return df.withColumn(name, df.select(F.sum(value).alias(name)).scalar())


def with_partition_total(
    df: DataFrame, name: str, value: str, partition: list[str]
) -> DataFrame:
    """Add the sum per partition by a join, so that no task holds a whole partition."""
    totals = df.groupBy(*[F.col(k).alias(f"_total_{k}") for k in partition]).agg(
        F.sum(value).alias(name)
    )
    same = F.lit(True)
    for k in partition:
        same = same & F.col(k).eqNullSafe(F.col(f"_total_{k}"))
    return df.join(totals, same, "left").select(*df.columns, name)


def share_of_total_global(df: DataFrame, name: str, value: str, share=M.money_share) -> DataFrame:
    """Add the percent of a column's sum over all rows that each row holds."""
    total = f"_{name}_total"
    return (
        with_total(df, total, value).withColumn(name, share(value, total)).drop(total)
    )


def share_of_total_partitioned(
    df: DataFrame, name: str, value: str, partition: list[str], share=M.money_share
) -> DataFrame:
    total = f"_{name}_total"
    return (
        with_partition_total(df, total, value, partition)
        .withColumn(name, share(value, total))
        .drop(total)
    )


def exact_percentiles(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of a decimal column in one row with four decimals, nulls left out.

    Only the values at the wanted positions are picked from the counted values.
    """
    before = rows_before(df.where(F.col(value).isNotNull()), value, descending=False)
    n = before.select(F.sum("_n").alias("n")).scalar()
    after = F.col("_before") + F.col("_n")
    picked, outputs = [], []
    for name, fraction in fractions.items():
        place = F.lit(fraction) * (n - 1)
        low, high = F.floor(place), F.ceil(place)
        picked += [
            F.min(F.when(after > low, F.col(value))).alias(f"{name}_low"),
            F.min(F.when(after > high, F.col(value))).alias(f"{name}_high"),
            F.max(place - low).alias(f"{name}_part"),
        ]
        gap = (F.col(f"{name}_high") - F.col(f"{name}_low")).cast("double")
        middle = F.col(f"{name}_low").cast("double") + gap * F.col(f"{name}_part")
        outputs.append(middle.cast("decimal(22,4)").alias(name))
    return before.agg(*picked).select(*outputs)

"""Profiling jobs: distribution, outliers, keys, coverage and naming of a table."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import measures, predicates
from tenderlake.operators.ranking import exact_percentiles


def profile_percentiles(df: DataFrame, value: str) -> DataFrame:
    """Exact median and 99th percentile, maximum, mean and number of the non-null values."""
    placed = exact_percentiles(df, value, {"mediana": 0.5, "p99": 0.99})
    overall = df.where(F.col(value).isNotNull()).agg(
        F.max(value).alias("maximo"),
        measures.money_mean(F.sum(value), F.count(value)).alias("media"),
        F.count(value).alias("total_linhas"),
    )
    # Both sides are one-row aggregates; the key only pairs them.
    return (
        placed.withColumn("_one", F.lit(1))
        .join(overall.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
    )


def profile_outlier_counts(
    df: DataFrame,
    original: str = "vl_original",
    current: str = "vl_atual",
    value_limit: Decimal | int = 1_000_000_000,
    ratio_limit: int = 100,
) -> DataFrame:
    """Rows over the value limit, over the ratio limit, over either, and over the value limit with
    both values nearly equal."""
    ratio = F.col(original) / F.nullif(F.col(current), F.lit(0))
    high = predicates.is_true(F.col(original) > value_limit)
    far = predicates.is_true(ratio > ratio_limit)
    close = predicates.is_true(F.abs(ratio - 1) < F.lit(Decimal("0.01")))
    return df.where(F.col(original).isNotNull()).agg(
        F.count_if(high).alias("acima_limite"),
        F.count_if(far).alias("razao_acima"),
        F.count_if(high | far).alias("uniao"),
        F.count_if(high & close).alias("acima_com_atual_tambem_alto"),
    )


def profile_key_uniqueness(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Rows, distinct values and duplicated rows of each candidate key.

    Each row is copied once per candidate and counted by key value, so all candidates share one
    shuffle; a null counts as a value.
    """
    copies = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("chave"),
                    # Lengths keep ("a", "bc") apart from ("ab", "c").
                    F.concat_ws(
                        "|",
                        *[
                            F.coalesce(
                                F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k).cast("string")),
                                F.lit("-"),
                            )
                            for k in key
                        ],
                    ).alias("valor"),
                )
                for name, key in candidates.items()
            ]
        )
    )
    per_value = (
        df.select(copies.alias("c")).groupBy("c.chave", "c.valor").agg(F.count(F.lit(1)).alias("n"))
    )
    return per_value.groupBy("chave").agg(
        F.sum("n").alias("qt_linhas"),
        F.count(F.lit(1)).alias("qt_valores"),
        (F.sum("n") - F.count(F.lit(1))).alias("qt_duplicadas"),
    )


def profile_collisions(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Values used under more than one owner, with the number of owners and rows."""
    return (
        df.groupBy(value)
        .agg(F.count_distinct(owner).alias("qt_donos"), F.count(F.lit(1)).alias("qt_linhas"))
        .where(F.col("qt_donos") > 1)
    )


def profile_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and of non-null values per column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    pairs = [
        F.struct(F.lit(c).alias("coluna"), F.col(f"_{i}").alias("qt_preenchidas"))
        for i, c in enumerate(columns)
    ]
    return counts.select("_rows", F.explode(F.array(*pairs)).alias("c")).select(
        "c.coluna", F.col("_rows").alias("qt_linhas"), "c.qt_preenchidas"
    )


def profile_outlier_share(df: DataFrame, flag: Column | str, value: str) -> DataFrame:
    """Part of a column's total that the flagged rows hold."""
    flagged = predicates.is_true(flag)
    return df.agg(
        F.sum(value).alias("soma_total"),
        F.sum(F.when(flagged, F.col(value))).alias("soma_marcadas"),
    ).withColumn("perc_marcadas", measures.money_share("soma_marcadas", "soma_total"))


def profile_row_count_by_year(sources: dict[str, DataFrame], date: str) -> DataFrame:
    """Rows per source and year of a date."""
    parts = [
        df.select(F.lit(name).alias("fonte"), F.year(date).alias("ano")) for name, df in sources.items()
    ]
    return (
        reduce(DataFrame.unionByName, parts).groupBy("fonte", "ano").agg(F.count(F.lit(1)).alias("qt_linhas"))
    )


def profile_name_drift(df: DataFrame, code: str, name: str) -> DataFrame:
    """Codes that go with more than one name."""
    return (
        df.groupBy(code)
        .agg(F.count_distinct(name).alias("qt_nomes"))
        .where(F.col("qt_nomes") > 1)
    )


def distinct_pairs(df: DataFrame, code: str, name: str) -> DataFrame:
    return df.select(code, name).distinct()

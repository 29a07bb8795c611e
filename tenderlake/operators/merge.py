"""Keyed merges of snapshots: last write, source precedence, change history and overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Every task keeps one row per key before the shuffle, so the copies of a hot key do not travel.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") == 1).drop("_place")
    )


def merge_latest(
    current: DataFrame, incoming: DataFrame, key: list[str], recency: list[str]
) -> DataFrame:
    """Upsert by key, the last write wins; merging the same rows again changes nothing.

    An incoming row wins a tie on recency. Rows of one side that tie are told apart by their content,
    so the outcome is always the same. Each side is brought down to one row per key on its own, and the
    sides are compared where that leaves them: a side that an earlier merge made is not shuffled again,
    and incoming rows that are merged twice are shuffled once.
    """
    kinds = current.unionByName(incoming).schema
    latest = [F.col(c).desc_nulls_last() for c in recency]
    content = F.xxhash64(*sorted(current.columns))

    def best(side: DataFrame) -> DataFrame:
        rows = side.select(*[F.col(f.name).cast(f.dataType) for f in kinds])
        return best_per_key(rows, key, [*latest, content.asc()])

    both = best(current).withColumn("_incoming", F.lit(False)).unionByName(best(incoming).withColumn("_incoming", F.lit(True)))
    return best_per_key(both, key, [*latest, F.col("_incoming").desc()]).drop("_incoming")


def source_precedence_merge(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row per key from the source named first among those that hold the key.

    The names are ordered from the highest precedence to the lowest. ``fl_nao_auditado`` marks rows
    that only the lowest source holds. Columns that a source lacks are null.
    """
    tagged = [
        df.withColumns({"fonte": F.lit(name), "_prioridade": F.lit(place)})
        for place, (name, df) in enumerate(sources.items())
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    content = F.xxhash64(*sorted(c for c in merged.columns if c != "_prioridade"))
    kept = best_per_key(merged, key, [F.col("_prioridade").asc(), content.asc()])
    return kept.withColumn("fl_nao_auditado", F.col("_prioridade") == len(sources) - 1).drop(
        "_prioridade"
    )


def source_overlap(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Number of distinct keys held by the left side only, the right side only, and both."""
    tagged = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("so_esquerda"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("so_direita"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("em_ambas"),
    )


def history_scd2(
    history: DataFrame | None,
    snapshot: DataFrame,
    key: list[str],
    tracked: list[str],
    taken_at: str,
) -> DataFrame:
    """Change history after one more snapshot: (key, tracked, valid_from, valid_to).

    A row with an open end holds the present state. A key whose tracked columns changed is closed
    and opened anew; a new key is opened; unchanged and vanished keys stay as they are. Of the rows
    of a snapshot that repeat a key one is taken, by its content, so a hot value cannot pile up in
    the join.
    """
    moment = F.to_date(F.lit(taken_at))
    now = best_per_key(snapshot.select(*key, *tracked), key, [F.xxhash64(*tracked).asc(), *[F.col(c).asc() for c in tracked]])
    fresh = now.withColumns({"valid_from": moment, "valid_to": F.lit(None).cast("date")})
    if history is None:
        return fresh
    columns = [*key, *tracked, "valid_from", "valid_to"]
    is_open = F.col("valid_to").isNull()
    present = history.where(is_open)
    old, new = present.alias("old"), now.withColumn("_seen", F.lit(True)).alias("new")
    same_key = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key])
    unchanged = reduce(
        lambda a, b: a & b, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in tracked]
    )
    known = F.col("old.valid_from").isNotNull()
    seen = F.col("new._seen").isNotNull()
    changed = known & seen & ~unchanged
    before = F.struct(
        *[F.col(f"old.{c}").alias(c) for c in [*key, *tracked]],
        F.col("old.valid_from").alias("valid_from"),
        F.when(changed, moment).alias("valid_to"),
    )
    after = F.struct(
        *[F.col(f"new.{c}").alias(c) for c in [*key, *tracked]],
        moment.alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    versions = (
        F.when(changed, F.array(before, after)).when(known, F.array(before)).otherwise(F.array(after))
    )
    updated = (
        old.join(new, same_key, "full_outer").select(F.explode(versions).alias("v")).select("v.*")
    )
    return history.where(~is_open).select(*columns).unionByName(updated.select(*columns))

"""Tables between the steps of an operator, written once to the folder that all executors share."""

from __future__ import annotations

import shutil
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tenderlake
from tenderlake.session import new_folder


@lru_cache(maxsize=1)
def _archive() -> str:
    package = Path(tenderlake.__file__).parent
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='tenderlake-')}/tenderlake", "zip", package.parent, package.name)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    spark.sparkContext.addPyFile(_archive())


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table and read it back: its plan is cut, each branch reads only its columns, and a
    lost executor brings back no earlier step."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_text(column: str = "text") -> Column:
    """A text whose null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_column(df: DataFrame, name: str = "doc_id") -> Column:
    """The identifier as a bigint, whatever integer type the table holds."""
    return df[name].cast("bigint").alias(name)

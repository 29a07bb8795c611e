"""Snapshot files that Spark derives from the given tables, clean or dirty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.session import compiled_methods, new_folder, shuffles_dropped
from tenderlake.sources.orders_view import as_text, contracts_from_orders

# Columns a published file has beyond the known ones.
EXTRA = ["origem", "tags", "indice"]
# Edital numbers that make a row dirty, and how.
ESCAPED, TRUNCATED, BROKEN_LINE, TOO_LONG = "07", "013", "021", "029"
INSIDE_QUOTES = ' disse \\"oi; tchau\\" fim'
# Rows of one file, some 150 MB of text: a compressed file is read by one task, so it stays small.
FILE_ROWS = 200_000
# Level 4 takes 1.3 us a row more than the fastest one and 15 % less disk; from level 5 on time grows faster.
_PACKED = {"compression": "gzip", "zlib.compress.level": "FOUR"}


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def dirty_lines(text: DataFrame) -> DataFrame:
    """One line of text per contract; some have backslash-escaped quotes, a line break inside
    quotes, too few or too many fields."""
    kind = F.col("nuedital")
    fields = []
    for name in contract.RAW_COLUMNS:
        value = F.col(name)
        if name == "objeto":
            shown = F.coalesce(value, F.lit(""))
            # Not through the quoting of the other fields: that would double the quotes.
            cell = (
                F.when(kind == ESCAPED, F.concat(F.lit('"'), shown, F.lit(INSIDE_QUOTES + '"')))
                .when(kind == BROKEN_LINE, _quoted(F.concat(shown, F.lit("\nsegunda; linha"))))
                .otherwise(_quoted(value))
            )
        else:
            cell = _quoted(value)
        fields.append(F.coalesce(cell, F.lit("")))
    known = F.concat_ws(";", *fields)
    extra = F.lit(";origem;;x")
    return text.select(
        F.when(kind == TRUNCATED, known)
        .when(kind == TOO_LONG, F.concat(known, extra, F.lit(";a mais")))
        .otherwise(F.concat(known, extra))
        .alias("value")
    )


def write_dirty_snapshot(
    spark: SparkSession, folder: str, path: str | None = None, file_rows: int = FILE_ROWS
) -> str:
    """The contracts as ``;`` files, each headed by upper-case names and the extra columns."""
    path = path or new_folder(spark, "snapshot")
    header = ";".join(n.upper() for n in [*contract.RAW_COLUMNS, *EXTRA])
    lines = dirty_lines(as_text(contracts_from_orders(spark, folder)))
    # The row that opens a file brings the header along; the lower 33 bits number the rows of a task.
    first = F.shiftrightunsigned(F.shiftleft(F.monotonically_increasing_id(), 31), 31) % file_rows == 0
    headed = F.when(first, F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value"))
    with compiled_methods(spark), shuffles_dropped(spark):
        lines.select(headed.alias("value")).write.options(**_PACKED, maxRecordsPerFile=file_rows).text(path)
    return path


def write_archive(df: DataFrame, path: str, sep: str, encoding: str, extra: list[str]) -> None:
    """A clean file set with upper-case names, its own delimiter and encoding, and extra columns."""
    named = df.select(
        *[F.lit("x").alias(e.upper()) for e in extra], *[F.col(c).alias(c.upper()) for c in df.columns]
    )
    with compiled_methods(df.sparkSession), shuffles_dropped(df.sparkSession):
        named.write.options(
            sep=sep, encoding=encoding, header=True, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=FILE_ROWS, **_PACKED,
        ).csv(path)

"""Boilerplate lines, told by the number of distinct sites they spread to.

A HyperLogLog sketch of the sites is kept per line and merged by aggregation, so a line that a third
of all rows hold is reduced in every task before it is exchanged. Lines whose estimate is within the
sketch's error of the threshold get an exact distinct count; the others are decided by the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.store import keep, plain_text

# Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
# log2 of a sketch's registers: a relative standard error of about 3 percent.
SKETCH_BITS = 10
# Estimates within this share of the threshold, five standard errors, are counted exactly.
MARGIN = 0.17


def line_key(line: Column) -> Column:
    """Lines are compared without white space at their ends, and as two hashes of their text."""
    bare = F.trim(F.regexp_replace(line, "[\\t\\r\\x0b\\x0c]", " "))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b"), F.length(bare).alias("n"))


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that is not blank."""
    return (
        docs.select("line_row", "line_doc", F.col(site).alias("line_site"), F.posexplode(F.split(plain_text(), "\n", -1)).alias("pos", "line"))
        .select("line_row", "line_doc", "line_site", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.col("key.n") > 0)
        .select("line_row", "line_doc", "line_site", "pos", "key.a", "key.b")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, bits: int = SKETCH_BITS, margin: float = MARGIN) -> DataFrame:
    """The lines (a, b) that ``min_sites`` distinct sites hold, with the place ``first`` of the copy to keep.

    Lines: line_row, line_doc, line_site, pos, a, b. A null site is not counted as a site.
    """
    sketched = lines.groupBy("a", "b").agg(
        F.hll_sketch_agg("line_site", F.lit(bits)).alias("sketch"),
        F.min(F.struct(F.col("line_doc").isNull().alias("unknown"), "line_doc", "line_row", "pos")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
    )
    sketched = sketched.filter(F.col("copies") >= min_sites).select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    sketched = keep(sketched.filter(F.col("sites") >= min_sites * (1 - margin)), "line-spread")
    sure = F.col("sites") > min_sites * (1 + margin)
    near = sketched.filter(~sure)
    exact = (
        lines.filter(F.col("line_site").isNotNull())
        .join(near.select("a", "b"), ["a", "b"], "left_semi")
        .select("a", "b", "line_site").distinct()
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("exact_sites"))
        .filter(F.col("exact_sites") >= min_sites)
    )
    return sketched.filter(sure).select("a", "b", "first").unionByName(near.join(exact, ["a", "b"]).select("a", "b", "first"))


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with all its columns and rows, boilerplate lines taken out of ``text``, and two more
    columns: ``n_lines_dropped`` and ``lines_dropped``, the positions of the dropped lines from 0.

    A line is boilerplate if at least ``min_sites`` distinct values of ``site`` hold it. With
    ``keep_first`` one copy stays, in the row of the smallest doc_id (a null doc_id comes last), so
    that a text mirrored on many sites is not lost; without it every copy goes. Within one row a
    line counts once per place. Blank lines are never dropped; the lines that stay keep their line
    breaks. A text whose lines all go becomes empty; a null text stays null. Rows with a null site
    lose boilerplate lines as well. The two new columns replace columns of the same name. An empty
    table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines_dropped", "lines_dropped")]
    docs = docs.select(*columns)
    # A row is found again by its identifier and content, not by its place in a scan that may run twice.
    docs = docs.withColumns({"line_doc": F.col("doc_id").cast("bigint"), "line_row": F.xxhash64("doc_id", plain_text(), F.col(site))})
    lines = keep(_lines(docs, site), "lines")
    hot = spread_lines(lines, min_sites)
    found = lines.join(hot, ["a", "b"])
    if keep_first:
        found = found.filter(~(F.col("line_row") == F.col("first.line_row")) | ~(F.col("pos") == F.col("first.pos")) | ~F.col("line_doc").eqNullSafe(F.col("first.line_doc")))
    dropped = found.groupBy("line_doc", "line_row").agg(F.array_sort(F.collect_set("pos")).alias("lines_dropped"))
    dropped = dropped.withColumnsRenamed({"line_doc": "line_doc2", "line_row": "line_row2"})
    joined = docs.join(dropped, docs["line_doc"].eqNullSafe(dropped["line_doc2"]) & (docs["line_row"] == dropped["line_row2"]), "left")
    nothing = F.col("lines_dropped").isNull()
    rest = F.array_join(
        F.filter(F.split(F.col("text"), "\n", -1), lambda line, i: ~F.array_contains(F.col("lines_dropped"), i)), "\n"
    )
    return joined.select(
        *[F.when(nothing, F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in columns],
        F.coalesce(F.size("lines_dropped"), F.lit(0)).cast("bigint").alias("n_lines_dropped"),
        F.coalesce("lines_dropped", F.array().cast("array<int>")).alias("lines_dropped"),
    )

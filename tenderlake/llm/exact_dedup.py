"""Exact duplicates by a tree merge of sorted digest runs. DataFrame operations only.

Every input partition is one sorted run of digests. In each round the runs whose numbers share all
but their lowest bits meet: they are exchanged by (group, digest), merged in key order, and one row
per digest is left, with the identifier that stays and the number of copies. After the last round a
single group is left. A digest reaches a round at most once per run, so however many copies a text
has, no merge gets more than ``fan_in`` rows of it.

A digest is never trusted alone: rows merge only if the text's length and a second, independent
hash agree as well, in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.store import id_column, keep, plain_text

# Digest, byte length and second hash: what rows must share to merge.
SAME = ["digest", "n_bytes", "check_hash"]
BITS = 3


def _first(side: str, column: str) -> Column:
    return (F.max if side == "largest" else F.min)(column)


def exact_groups(docs: DataFrame, stays: str = "smallest", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``stays`` names which doc_id of a group of equal texts stays: "smallest" or "largest".
    ``bits``: two to this power runs merge in a round.

    A null text counts as empty, so all null and empty texts are one group. A null doc_id loses to
    any other; keep_id is null only if every doc_id of the group is. Of repeated rows with the same
    doc_id and text exactly one is kept. Other columns are not read. An empty table gives no rows.
    """
    text = plain_text()
    hashed = keep(
        docs.select(
            id_column(docs),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.xxhash64(text).alias("check_hash"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # What decides who stays; a null identifier is behind all others on either side.
    if stays not in ("smallest", "largest"):
        raise ValueError(f"stays must be smallest or largest, not {stays}")
    null_last = F.col("doc_id").isNotNull() if stays == "largest" else F.col("doc_id").isNull()
    runs = hashed.groupBy("run", *SAME).agg(
        _first(stays, F.struct(null_last.alias("known"), "doc_id", "row")).alias("best"),
        F.count(F.lit(1)).alias("size"),
    )
    runs = keep(runs, "digest-runs")
    number = (runs.agg(F.max("run")).first()[0] or 0) + 1
    merged = runs
    while True:
        merged = (
            merged.withColumn("run", F.shiftright("run", bits))
            .groupBy("run", *SAME)
            .agg(_first(stays, "best").alias("best"), F.sum("size").alias("size"))
        )
        number = (number + (1 << bits) - 1) >> bits
        if number <= 1:
            break
    merged = merged.drop("run").withColumnsRenamed({"best": "stay", "size": "group_size"})
    # Back down the tree: each run learns the outcome for its digests, each row asks its own run.
    outcome = runs.select("run", *SAME).join(merged, SAME)
    return hashed.join(outcome, ["run", *SAME]).select(
        "doc_id",
        F.col("stay.doc_id").alias("keep_id"),
        "group_size",
        (F.col("stay.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

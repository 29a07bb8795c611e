"""Incremental work: act once on each newly landed snapshot, and upsert a stream of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.merge import merge_latest
from tenderlake.sources import tables

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incremental_file_trigger(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    work: Callable[[SparkSession, str, str], None],
    marker: str | None = None,
) -> int:
    """Run ``work(spark, folder, name)`` for each snapshot folder under ``landing`` not yet done.

    A snapshot is a folder landed under a new name; any file in it counts, whatever it is called.
    Where the files of a folder land one after the other, ``marker`` names a file that is written
    last, with some content: a folder is worked on only once it holds that. It counts as done once ``work`` has
    returned for it: the stream's checkpoint is committed after that, so a failed run is repeated
    and a run without news does nothing. Returns the number of snapshots worked on.
    """
    done = []

    def on_batch(files: DataFrame, _: int) -> None:
        # One row per snapshot folder reaches the driver, not one per file or row.
        folders = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
        for row in folders.orderBy("folder").collect():
            work(files.sparkSession, row.folder, row.folder.rsplit("/", 1)[-1])
            done.append(row.folder)

    # Only the path of each file is selected, so no content is read here.
    query = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("pathGlobFilter", marker or "*")
        .load(f"{landing}/*")
        .select("path")
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(done)


def merge_stream(
    updates: DataFrame, base: str, checkpoint: str, key: list[str], recency: list[str]
) -> None:
    """Upsert all rows that a stream has for now into the table under ``base``, the last write wins.

    Each batch publishes one new version, named after the batch; a batch that is repeated after its
    version was published does nothing.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = f"batch-{batch_id:010d}"
        path = tables.current_version(spark, base)
        if path is not None and tables.is_version(path, version):
            return
        current = spark.read.parquet(path) if path else batch.limit(0)
        tables.promote_snapshot(merge_latest(current, batch, key, recency), base, version)

    (
        updates.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

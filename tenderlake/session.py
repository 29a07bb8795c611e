"""Session settings and the shared folder used for checkpoints and landed files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# An aggregate with at most this many rows may be ranked in one task or broadcast.
SMALL_ROWS = 200_000


def build_session(app: str = "tenderlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        # The JVM never compiles a method over 8000 bytes; wide projections reach that, and run
        # faster as several small generated methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def compiled_methods(spark: SparkSession) -> AbstractContextManager[None]:
    """For a write of many derived columns: generated methods stay within the 8000 bytes that the JVM
    compiles, also in a session that ``build_session`` did not make."""
    return _with_setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """For a write that is read back: its shuffle files go as soon as it ends, where they would stay
    until the driver happens to collect its garbage."""
    return _with_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@lru_cache
def _private_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tenderlake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A private folder is made only for a local master, where every task runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return _private_folder(spark.sparkContext.applicationId)
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session's own that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Store an aggregate that several branches of a plan read; also return its row count.

    The rows are written once to the shared folder as Parquet, so the scan behind them is not
    repeated, each branch reads its columns only, and a lost executor brings nothing back. The count
    is observed during that write.
    """
    path, counted = new_folder(df.sparkSession, "aggregate"), Observation()
    with shuffles_dropped(df.sparkSession):
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), counted.get["rows"]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a table that lies in fewer pieces than there are cores.

    A table in many files keeps its partitions and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only for a counted, small side; otherwise leave the join to AQE."""
    return F.broadcast(df) if rows <= limit else df

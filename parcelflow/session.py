"""Session defaults shared by tests, benchmark and examples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "parcelflow", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC, ANSI, adaptive session; a cluster's own settings win where they exist."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan, dealt evenly where it has fewer splits than there are cores, so that dear expressions do not wait
    for one task. A larger scan stays as it is: no shuffle. For plain scans only, whose splits are known before they run."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Rows of a table that one task holds and sorts after ``dealt``.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Rows dealt by key to as many tasks as hold ``TASK_ROWS`` each, so that what a task sorts does not grow with the table;
    shuffles that go by the session's number of partitions, or merge small ones, give a task its share of any table. The rows
    are counted, which reads the footers alone of a plain scan; ``like`` is a frame of as many rows that is counted instead
    of a dear one. A single key stays whole."""
    tasks = -(-(like if like is not None else rows).count() // TASK_ROWS)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local master without one gets a temporary folder; on a cluster it must
    be set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parcelflow-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame, kind: str) -> Iterator[DataFrame]:
    """The frame, computed once and kept as compressed columns in the shared folder until the block ends; a checkpoint of
    wide rows takes several times the disk, and stays for as long as the driver refers to it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, kind)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block an action's shuffle files go when it ends, and not at some collection of the driver's heap."""
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES) if before is None else spark.conf.set(_SHUFFLES, before)

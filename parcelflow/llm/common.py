"""Helpers that several operators share: the shared folder, checkpoints, ordered ranges, batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that Spark hands to Python at once: documents may be long.
BATCH_BYTES = 4 << 20
#: Words whose hashes a worker remembers: the frequent ones; a rare one is as soon hashed as looked up.
MEMO_WORDS = 60_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI. Where none is set, a local master gets a temporary one (as in
    tests); a cluster has no folder that could stand in for it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parcelflow-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


_MADE: list[str] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the tables that this driver has stored in the shared folder so far. Frames made of them can't be computed
    after that, so call it when their results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and stored in the shared folder, so that a lost executor costs nothing upstream. (Spark
    removes a checkpoint with its frame, where spark.cleaner.referenceTracking.cleanCheckpoints is set.)"""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The frame as a compressed Parquet table in the shared folder, read back."""
    path = shared_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of rows that Spark hands to Python at once (a single larger row goes alone); a smaller setting of
    the session's is kept. It stays set, as frames are computed later; it bounds memory and changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if own > most or own <= 0:
        spark.conf.set(key, str(most))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as it takes to be none of the frame's columns."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
        taken.add(name.lower())
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` split points of an integer column in ascending order (a bounded aggregate, whatever the input);
    a key that fills whole ranges stands there as often as it does so. Nulls are left out."""
    if parts < 2:
        return []
    shares = ",".join(f"{i / parts:.8f}" for i in range(1, parts))
    row = df.agg(F.expr(f"approx_percentile({key}, array({shares}), {max(10_000, 20 * parts)})").alias("b")).first()
    return sorted(int(b) for b in row.b) if row and row.b else []


def range_id(key: str, bounds: list[int]) -> "F.Column":
    """The ordinal of the range that a key falls in, the number of bounds at or below it, by a binary search in a constant
    array; nulls go first."""
    if not bounds:
        return F.lit(0)
    steps = ",".join(str(1 << k) for k in reversed(range(len(bounds).bit_length())))
    points = f"from_json('{bounds}', 'array<bigint>')"
    return F.expr(f"aggregate(array({steps}), 0, (at, step) -> case when get({points}, at + step - 1) <= {key} then at + step else at end)")


_MEMO: dict[str, dict] = {}


def memo(kind: str, most: int) -> dict:
    """What this worker remembers of earlier texts for one ``kind`` of work, empty again beyond ``most`` entries. Workers
    live on between stages, so that another kind drops the last one's: memos do not add up. It changes no result."""
    if len(_MEMO.get(kind, ())) > most or kind not in _MEMO:
        _MEMO.clear()
        _MEMO[kind] = {}
    return _MEMO[kind]


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in stream:
        if batch.num_rows:
            yield {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}

"""Snapshots against what is stored: dispositions, upserts, quarantine, counters, checkpoints and publication.

Plain Parquet has no MERGE: an upsert is one full outer join by key and a rewrite, published by a numbered manifest;
``buckets`` has tables of which an upsert writes only what changed.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CREATED, UPDATED, UNCHANGED, ABSENT = "created", "updated", "unchanged", "absent"
NORMALIZATION_VERSION = 2


class DuplicateSourceIdentifier(ValueError):
    """A record stands in one snapshot twice; the whole run stops and nothing is published."""


class AlreadyPublished(RuntimeError):
    """Another run has published over the state that this one took."""


class UnstableSnapshot(ValueError):
    """The source changed between the first and the last row that was read."""


@dataclass(frozen=True)
class Checkpoint:
    """What must be equal for a snapshot to count as seen."""

    dataset: str
    dataset_id: str
    revision: str
    schema_fingerprint: str
    row_count: int


def unchanged_revision(previous: Checkpoint | None, current: Checkpoint, mode: str = "INCREMENTAL") -> bool:
    """Whether an incremental run may stop before it reads a row."""
    return mode == "INCREMENTAL" and previous == current


def duplicates(rows: DataFrame, key: str = "record_key") -> DataFrame:
    """(key, n) of the keys that stand there more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, key: str = "record_key") -> None:
    found = duplicates(rows, key).limit(5).collect()  # a sample for the message
    if found:
        raise DuplicateSourceIdentifier(", ".join(str(r[0]) for r in found))


def require_stable(first: Checkpoint, last: Checkpoint, rows: int) -> None:
    """The revision and schema at the end are those at the beginning, and as many rows came as were announced."""
    if (first.revision, first.schema_fingerprint) != (last.revision, last.schema_fingerprint) or rows != first.row_count:
        raise UnstableSnapshot(f"{rows} rows of {first.row_count}, revision {first.revision} to {last.revision}")


def diff(stored: DataFrame, incoming: DataFrame, key: str = "record_key", checksum: str = "checksum") -> DataFrame:
    """(key, disposition, old_checksum, new_checksum) of every record on either side: one full outer join by key on two
    narrow tables. A stored record with a null ``processed`` flag counts as updated, so that it is done again."""
    ready = F.coalesce("processed", F.lit(False)) if "processed" in stored.columns else F.lit(True)
    old = stored.select(key, F.col(checksum).alias("old_checksum"), ready.alias("_ready"))
    new = incoming.select(key, F.col(checksum).alias("new_checksum"))
    both = old.join(new, key, "full_outer")
    kind = (
        F.when(F.col("new_checksum").isNull(), ABSENT).when(F.col("old_checksum").isNull(), CREATED)
        .when((F.col("old_checksum") == F.col("new_checksum")) & F.col("_ready"), UNCHANGED).otherwise(UPDATED)
    )
    return both.select(key, kind.alias("disposition"), "old_checksum", "new_checksum")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows and failures."""
    return rows.filter(F.col("error_code").isNull()), rows.filter(F.col("error_code").isNotNull()).select("record_key", "error_code", "error_message", "payload", "checksum")


def identity_mismatch(raw_key: Column, normalized_key: Column) -> Column:
    return F.when(~raw_key.eqNullSafe(normalized_key), "PROVIDER_IDENTITY_MISMATCH")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "record_key", keep_known: tuple[str, ...] = ("latitude", "longitude"), changed_only: bool = False) -> DataFrame:
    """The stored rows with the incoming ones over them; ``changed_only``: those that are new or whose checksum differs. A null never replaces a known value of ``keep_known``; a changed
    row goes back to PENDING and one normalisation version down, so that it is matched again; ``first_observed_at`` stays
    the earliest. Rows that the snapshot lacks stay."""
    names = [c for c in stored.columns if c != key]
    both = stored.alias("s").join(incoming.alias("i"), key, "right" if changed_only else "full_outer")
    old, new = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"i.{c}"))
    arrived, had = new("checksum").isNotNull(), old("checksum").isNotNull()
    changed = arrived & had & (new("checksum") != old("checksum"))

    def merged(name: str) -> Column:
        if name == "match_status":
            return F.when(changed | ~had, "PENDING").otherwise(old(name))
        if name == "normalization_version":
            return F.when(changed | ~had, NORMALIZATION_VERSION - 1).otherwise(old(name))
        if name not in incoming.columns:
            return old(name)
        if name == "first_observed_at":
            return F.least(old(name), new(name))
        if name in keep_known:
            return F.coalesce(new(name), old(name))
        return F.when(arrived, new(name)).otherwise(old(name))

    if changed_only:
        both = both.filter(changed | ~had)
    return both.select(key, *[merged(n).alias(n) for n in names])


def counters(dispositions: DataFrame, failures: DataFrame, skipped: int = 0) -> DataFrame:
    """fetched, created, updated, skipped, failed and status of a run, in one line; ``skipped`` more were unchanged than
    ``dispositions`` has."""
    own = dispositions.agg(*[(F.count_if(F.col("disposition") == k) + F.lit(more).cast("long")).alias(n) for k, n, more in ((CREATED, "created", 0), (UPDATED, "updated", 0), (UNCHANGED, "skipped", skipped))])
    both = own.join(failures.agg(F.count("*").alias("failed")), F.lit(True))
    fetched = F.col("created") + F.col("updated") + F.col("skipped") + F.col("failed")
    return both.select(fetched.alias("fetched"), "created", "updated", "skipped", "failed", F.when(F.col("failed") > 0, "PARTIALLY_SUCCEEDED").otherwise("SUCCEEDED").alias("status"))


def pending(permits: DataFrame, version: int = NORMALIZATION_VERSION) -> DataFrame:
    """The permits that a matching run takes up."""
    return permits.filter((F.col("match_status") == "PENDING") | (F.col("normalization_version") < version))


# ------------------------------------------------------------- publication


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _listed(spark: SparkSession, folder: str) -> list:
    """The file system's entries of a folder; none if it is not there."""
    fs, make = _hadoop(spark, folder)
    return list(fs.listStatus(make(folder))) if fs.exists(make(folder)) else []


def _written(spark: SparkSession, path: str) -> dict | None:
    """A manifest, or nothing if the run that wrote it did not finish."""
    fs, make = _hadoop(spark, path)
    stream = fs.open(make(path))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def manifests(spark: SparkSession, root: str) -> list[int]:
    """The numbers of what was published or begun, ascending."""
    names = (s.getPath().getName() for s in _listed(spark, f"{root}/manifests"))
    return sorted(int(n[2:14]) for n in names if n.startswith("m-"))


def _manifest_path(root: str, number: int) -> str:
    return f"{root}/manifests/m-{number:012d}.json"


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Write one manifest to a name that must be free: of two runs that took the same state, the second fails. A line end
    says that it is whole."""
    fs, make = _hadoop(spark, root)
    target = make(_manifest_path(root, number))
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            raise AlreadyPublished(f"another run has published {target.getName()}") from None
        raise
    try:
        out.write(bytearray((json.dumps(content) + "\n").encode()))
    finally:
        out.close()


def newest(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict | None]:
    """The number to publish under next less one, and the newest whole manifest; with ``number``, that one's."""
    numbers = manifests(spark, root)
    if number is not None:
        return number, _written(spark, _manifest_path(root, number)) if number in numbers else None
    for n in reversed(numbers):
        if found := _written(spark, _manifest_path(root, n)):
            return numbers[-1], found | {"number": n}
    return (numbers[-1] if numbers else 0), None


def publish(df: DataFrame, root: str, checkpoint: Checkpoint | None = None, advance: bool = True) -> str:
    """Write a version of a table below ``root`` and, last, a manifest of its own, numbered one above the newest. Readers
    follow the newest whole manifest, so that a run that fails or stops at any point leaves what was published as it was.
    ``advance``: only full snapshots move the checkpoint on."""
    version, spark = f"v-{uuid.uuid4().hex}", df.sparkSession
    number, previous = newest(spark, root)
    df.write.parquet(f"{root}/{version}")
    kept = asdict(checkpoint) if checkpoint and advance else (previous or {}).get("checkpoint")
    commit(spark, root, number + 1, {"version": version, "checkpoint": kept})
    return version


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    return newest(spark, root, number)[1]


def last_checkpoint(spark: SparkSession, root: str) -> Checkpoint | None:
    own = (manifest(spark, root) or {}).get("checkpoint")
    return Checkpoint(**own) if own else None


def published(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The newest version, or, for readers that ask more than once, the one of a manifest's number."""
    own = manifest(spark, root, number)
    return spark.read.parquet(f"{root}/{own['version']}") if own else None


def vacuum(spark: SparkSession, root: str, older_than_s: float, now: float | None = None) -> list[str]:
    """Remove manifests that a newer whole one replaced more than ``older_than_s`` seconds ago, and folders of that age that
    no manifest left names. What was removed. Readers pinned to a number have that long to finish."""
    numbers, names = manifests(spark, root), {}
    limit = ((now or time.time()) - older_than_s) * 1000
    fs, make = _hadoop(spark, root)
    changed = {s.getPath().getName(): s.getModificationTime() for s in _listed(spark, f"{root}/manifests")}
    whole = [n for n in numbers if (names.setdefault(n, _written(spark, _manifest_path(root, n)))) is not None]
    gone, kept = [], []
    for n in numbers:
        after = [changed[f"m-{m:012d}.json"] for m in whole if m > n]
        (gone if after and after[0] < limit else kept).append(n)
    used = {folder for n in kept if names[n] for folder in [names[n].get("version"), *names[n].get("folders", {}).values()]}
    removed = []
    for status in _listed(spark, root):
        name = status.getPath().getName()
        if name != "manifests" and name not in used and status.isDirectory() and status.getModificationTime() < limit:
            removed.append(name)
    for n in gone:  # manifests first, so that none names a folder that is not there
        fs.delete(make(_manifest_path(root, n)), False)
    for name in removed:
        fs.delete(make(f"{root}/{name}"), True)
    return removed

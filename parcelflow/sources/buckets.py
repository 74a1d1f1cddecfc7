"""Tables in hash buckets, of which a run writes only what changed.

A bucket is a base and, above it, deltas: rows that were new or differed, by the number of the run that wrote them. Which
folders make up a bucket stands in a numbered manifest, as for whole snapshots; files are never changed once they are
named there. Compaction writes new bases for buckets with many deltas. Readers see one manifest throughout.

A key's bucket is the hash by which Spark deals rows, modulo the number of buckets. So rows that ``dealt`` has dealt, joined on
the way with others dealt alike, are written from where they are (``lay``, ``name``), without a shuffle of wide rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import session
from . import snapshot

BUCKETS = 256
#: Deltas above which a bucket is compacted.
MOST_DELTAS = 8
_RUN = "_run"


#: Tasks' worth of rows that ``groups`` lets one pass deal at once, which bounds the shuffle files of a large write.
PASS_TASKS = 200
#: The bucket, named by no manifest, of rows that are written beside a table's own.
ASIDE = -1
#: Functions of the key; tables whose manifests name none were written by the first.
_HASHES = {None: F.xxhash64, "hash": F.hash}


def bucket_of(key: str, buckets: int, hashed: str | None = "hash") -> Column:
    return F.pmod(_HASHES[hashed](key), F.lit(buckets)).cast("int")


def tasks(rows: int, buckets: int) -> int:
    """So many tasks that each has rows of one bucket, and of no more rows than a task holds."""
    return buckets * max(1, -(-rows // (session.TASK_ROWS * buckets)))


def groups(rows: int, buckets: int) -> list[range]:
    """The buckets in as many groups as passes are needed, so that each pass deals about ``PASS_TASKS`` tasks' rows."""
    most = max(1, buckets * PASS_TASKS * session.TASK_ROWS // max(rows, 1))
    return [range(b, min(b + most, buckets)) for b in range(0, buckets, most)]


def _append(parts: Iterable[DataFrame], root: str, kind: str, key: str, buckets: int, hashed: str | None = "hash", aside: Column | None = None) -> tuple[str, list[int]]:
    """Write rows to a new folder, where they are, a subfolder for each bucket with rows; the folder and these buckets. Parts
    are written one after the other. Rows of which ``aside`` holds lie in a subfolder of their own."""
    folder, own = f"{kind}-{uuid.uuid4().hex}", bucket_of(key, buckets, hashed)
    for rows in parts:
        spark, placed = rows.sparkSession, rows.withColumn("bucket", own if aside is None else F.when(aside, ASIDE).otherwise(own))
        placed.write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/{folder}")
    names = (s.getPath().getName() for s in snapshot._listed(spark, f"{root}/{folder}"))
    return folder, sorted({int(n.split("=")[1]) for n in names if n.startswith("bucket=")} - {ASIDE})


def _write(rows: DataFrame, root: str, kind: str, key: str, buckets: int, like: DataFrame | None = None, hashed: str | None = "hash") -> tuple[str, list[int]]:
    """Deal rows and write them. A bucket of more rows than a task holds is written by several, each its slice of the keys, in a
    file of its own: what a task sorts and writes does not grow with the table. ``like`` has as many rows at least, and is
    counted instead of dear ones."""
    dealt = rows.repartition(tasks((rows if like is None else like).count(), buckets), key)
    return _append([dealt], root, kind, key, buckets, hashed)


@dataclass(frozen=True)
class Laid:
    """Rows in a folder below a table's root that no manifest names yet, and the state of the table that they were written for."""

    root: str
    folder: str
    filled: list[int]
    number: int
    own: dict | None


def lay(spark: SparkSession, parts: Iterable[DataFrame], root: str, key: str = "record_key", buckets: int = BUCKETS, aside: Column | None = None) -> Laid:
    """Write rows with distinct keys, where they are, as a table's base or next delta. They should be dealt by key to
    ``tasks``; any others have the same result in more files. Columns that the table lacks are written and not read by it."""
    number, own = snapshot.newest(spark, root)
    if own is None:
        return Laid(root, *_append(parts, root, "base", key, buckets, aside=aside), number, own)
    deltas = (rows.withColumn(_RUN, F.lit(number + 1).cast("long")) for rows in parts)
    return Laid(root, *_append(deltas, root, "delta", own["key"], own["buckets"], own.get("hash"), aside), number, own)


def name(spark: SparkSession, laid: Laid, schema: StructType, key: str = "record_key", buckets: int = BUCKETS, checkpoint: snapshot.Checkpoint | None = None) -> None:
    """Publish what was laid; ``schema``, ``key`` and ``buckets`` are those of a new table."""
    kept = {"checkpoint": asdict(checkpoint)} if checkpoint else {}
    if laid.own is None:
        content = {"key": key, "buckets": buckets, "hash": "hash", "schema": schema.jsonValue(), "folders": {"1": laid.folder}, "parts": {str(b): [1] for b in laid.filled}, "checkpoint": None} | kept
    else:
        content = _next(laid.own, kept)
        if laid.filled:
            content["folders"][str(laid.number + 1)] = laid.folder
            for b in laid.filled:  # a delta above no base is the base
                content["parts"].setdefault(str(b), []).append(laid.number + 1)
    snapshot.commit(spark, laid.root, laid.number + 1, content)


def laid_rows(spark: SparkSession, laid: Laid, schema: StructType) -> DataFrame:
    """These columns of all that was laid, beside the buckets too, with the bucket."""
    return spark.read.schema(StructType([*schema.fields]).add("bucket", "integer")).parquet(f"{laid.root}/{laid.folder}")


def forget_aside(spark: SparkSession, laid: Laid) -> None:
    """Remove what lies beside the buckets."""
    fs, make = snapshot._hadoop(spark, laid.root)
    fs.delete(make(f"{laid.root}/{laid.folder}/bucket={ASIDE}"), True)


def create(rows: DataFrame, root: str, key: str = "record_key", buckets: int = BUCKETS, checkpoint: snapshot.Checkpoint | None = None) -> None:
    """A new table of rows with distinct keys."""
    number, previous = snapshot.newest(rows.sparkSession, root)
    if previous:
        raise ValueError(f"{root} has a table")
    name(rows.sparkSession, Laid(root, *_write(rows, root, "base", key, buckets), number, None), rows.schema, key, buckets, checkpoint)


def most_rows(spark: SparkSession, root: str) -> int:
    """As many rows as a table has at most, by its files' footers: a key counts in its base and in each delta."""
    own = snapshot.manifest(spark, root)
    paths = [f"{root}/{own['folders'][str(i)]}/bucket={b}" for b, ids in own["parts"].items() for i in ids] if own else []
    return spark.read.schema(StructType.fromJson(own["schema"])).parquet(*paths).count() if paths else 0


def read(spark: SparkSession, root: str, number: int | None = None, only: Iterable[int] | None = None, columns: list[str] | None = None) -> DataFrame | None:
    """The rows of a table, of its newest manifest or of one's number; ``only`` these buckets. Rows of a base whose key a
    delta has are left out, and of a key's deltas the newest counts; buckets without deltas are plain scans. ``columns``
    (with the key) reach the scan."""
    own = snapshot.manifest(spark, root, number)
    return None if own is None else _rows(spark, root, own, only, columns)


def _rows(spark: SparkSession, root: str, own: dict, only: Iterable[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    key, schema = own["key"], StructType.fromJson(own["schema"])
    wanted = None if only is None else {str(b) for b in only}
    parts = {b: ids for b, ids in own["parts"].items() if wanted is None or b in wanted}
    kept = schema if columns is None else StructType([f for f in schema.fields if f.name in {key, *columns}])
    path = lambda b, i: f"{root}/{own['folders'][str(i)]}/bucket={b}"
    base = [path(b, ids[0]) for b, ids in parts.items()]
    plain = [path(b, ids[0]) for b, ids in parts.items() if len(ids) == 1]
    covered = [path(b, ids[0]) for b, ids in parts.items() if len(ids) > 1]
    scan = lambda paths, more=(): spark.read.schema(StructType([*kept.fields, *more])).parquet(*paths)
    if not base:
        return spark.createDataFrame([], kept)
    out = scan(plain) if plain else None
    if covered:
        once = [path(b, i) for b, ids in parts.items() if len(ids) == 2 for i in ids[1:]]
        often = [path(b, i) for b, ids in parts.items() if len(ids) > 2 for i in ids[1:]]
        late = scan(once).select(kept.names) if once else None  # one delta has a key once
        if often:
            deltas = scan(often, StructType().add(_RUN, "long").fields)
            last = deltas.groupBy(key).agg(F.max_by(F.struct(*kept.names), _RUN).alias("r")).select("r.*")
            late = last if late is None else late.unionByName(last)
        under = scan(covered).join(late.select(key), key, "left_anti").select(kept.names)
        both = under.unionByName(late)
        out = both if out is None else out.unionByName(both)
    return out.select(columns) if columns else out


def merge(incoming: DataFrame, root: str, combine: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: snapshot.Checkpoint | None = None) -> list[int]:
    """Put incoming rows with distinct keys over a table: ``combine(stored, incoming)`` gives the rows that are new or changed,
    in the table's columns, where ``stored`` has the rows of incoming keys, out of their buckets alone. These rows are one delta; the buckets
    that it has rows of. Without changes nothing is written but a checkpoint."""
    spark = incoming.sparkSession
    number, own = snapshot.newest(spark, root)
    key, buckets = own["key"], own["buckets"]
    touched = [r.b for r in incoming.select(bucket_of(key, buckets, own.get("hash")).alias("b")).distinct().collect()]  # as many as buckets at most
    if not touched:
        return []
    stored = _rows(spark, root, own, touched).join(incoming.select(key), key, "left_semi")
    names = StructType.fromJson(own["schema"]).names
    changed = combine(stored, incoming).select(names).withColumn(_RUN, F.lit(number + 1).cast("long"))
    laid = Laid(root, *_write(changed, root, "delta", key, buckets, incoming, own.get("hash")), number, own)
    name(spark, laid, incoming.schema, checkpoint=checkpoint)
    return laid.filled


def _next(own: dict, more: dict) -> dict:
    content = {k: v for k, v in own.items() if k != "number"} | more
    return content | {"folders": dict(own["folders"]), "parts": {b: list(ids) for b, ids in own["parts"].items()}}


def compact(spark: SparkSession, root: str, most_deltas: int = MOST_DELTAS) -> list[int]:
    """Give buckets with more than so many deltas a new base; which they were. Others' files stay as they are."""
    number, own = snapshot.newest(spark, root)
    many = [int(b) for b, ids in (own or {"parts": {}})["parts"].items() if len(ids) > most_deltas + 1]
    if not many:
        return []
    folder, filled = _write(_rows(spark, root, own, many), root, "base", own["key"], own["buckets"], hashed=own.get("hash"))
    content = _next(own, {})
    content["folders"][str(number + 1)] = folder
    content["parts"] |= {str(b): [number + 1] for b in filled}
    named = {str(i) for ids in content["parts"].values() for i in ids}
    content["folders"] = {i: f for i, f in content["folders"].items() if i in named}
    snapshot.commit(spark, root, number + 1, content)
    return sorted(filled)

"""Import runs into bucketed tables: what was seen before is recognised by its checksum and never parsed again.

Below a run's root lie ``seen`` (record_key, checksum, error_code of every row that ever came), ``permits`` (the sound ones,
uniform) and ``failures`` by run. A run compares keys and checksums, makes uniform what is new or differs, and writes
deltas to the buckets of these rows. The permits go first: a run that stops before ``seen`` is written does these rows
again, and finds them unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_removed, stored
from . import buckets, permits, snapshot

_SEEN = ["record_key", "checksum", "error_code"]
#: Columns of which a null never replaces a known value.
_KEPT = ("latitude", "longitude")
_KIND, _ERROR, _STORED = (f"{permits.ADDED}{n}" for n in ("kind", "error", "stored"))


def _before(column: str) -> str:
    return f"{permits.ADDED}{column}"


@dataclass(frozen=True)
class Run:
    """What a run did: its counters, as ``snapshot.counters`` has them, the rows that it parsed, and the buckets of permits
    that it wrote to."""

    counters: DataFrame
    parsed: int
    buckets: list[int]


def table(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The permits, of the newest run or as of one manifest."""
    return buckets.read(spark, f"{root}/permits", number)


def changes(own: DataFrame, root: str, tasks: int, only: range) -> DataFrame:
    """Identified rows of ``only`` these buckets, dealt by key to so many tasks, with their disposition against what was seen,
    and the error that a row had then."""
    seen = buckets.read(own.sparkSession, f"{root}/seen", only=only, columns=_SEEN)
    if seen is None:
        return own.withColumns({_KIND: F.lit(snapshot.CREATED), _ERROR: F.lit(None).cast("string")})
    before = seen.select("record_key", F.unhex("checksum").alias("_old"), F.col("error_code").alias(_ERROR)).repartition(tasks, "record_key")
    kind = F.when(F.col("_old").isNull(), snapshot.CREATED).when(F.col("_old") == F.unhex("checksum"), snapshot.UNCHANGED).otherwise(F.when(F.col(_ERROR).isNull(), snapshot.UPDATED).otherwise(snapshot.CREATED))
    return own.join(before, "record_key", "left").withColumn(_KIND, kind).drop("_old")


def latest(rows: DataFrame) -> DataFrame:
    """One row of each record: the last by the source's time of change, then by checksum. For streams of changes; a snapshot
    with two rows of a record is an error."""
    own = rows.groupBy("record_key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(F.col("`:updated_at`"), "checksum")).alias("r"))
    return own.select("record_key", *[F.col(f"r.`{c}`") for c in rows.columns if c != "record_key"])  # the key as grouped, so that rows stay dealt by it


def run(raw: DataFrame, dataset: permits.Dataset, root: str, whole: bool = True, table_buckets: int = buckets.BUCKETS, checkpoint: snapshot.Checkpoint | None = None, label: str | None = None) -> Run:
    """One import. ``whole``: the rows are a snapshot, in which a record stands once, else the run stops before it writes;
    if not, the latest row of each record counts. Rows without an identifier fail under their checksum, equal ones as one.
    Rows that failed before are tried again, so that the run's failures, below ``label``, are all of the snapshot's.

    The raw rows are read once and kept as compressed columns. They are dealt by key, meet what was seen and what is stored
    there, are made uniform, and are written to their buckets by the same task: wide rows are shuffled once, raw. Large runs
    do so for one group of buckets after the other, so that shuffle files do not grow with the table."""
    spark = raw.sparkSession
    keyed = permits.identified(raw, dataset).drop("checksum")
    with shuffles_removed(spark), stored(keyed, "arrived") as arrived:
        unnamed = F.col("record_key").startswith("invalid:")
        if whole:
            snapshot.require_unique(arrived.filter(~unnamed))
        return _run(arrived, raw.columns, unnamed, dataset, root, whole, table_buckets, checkpoint, label)


def _run(arrived: DataFrame, columns: list[str], unnamed: Column, dataset: permits.Dataset, root: str, whole: bool, table_buckets: int, checkpoint: snapshot.Checkpoint | None, label: str | None) -> Run:
    spark, own = arrived.sparkSession, snapshot.manifest(arrived.sparkSession, f"{root}/permits") or {"buckets": table_buckets, "hash": "hash"}
    seen = snapshot.manifest(spark, f"{root}/seen") or own
    held, alike = max(arrived.count(), buckets.most_rows(spark, f"{root}/seen"), buckets.most_rows(spark, f"{root}/permits")), [(t["buckets"], t.get("hash")) for t in (own, seen)]
    tasks = buckets.tasks(held, own["buckets"])
    passes = buckets.groups(held, own["buckets"]) if alike[0] == alike[1] else [None]
    state = {"match_status": F.lit("PENDING"), "normalization_version": F.lit(snapshot.NORMALIZATION_VERSION - 1)}
    added = [_KIND, _STORED, *map(_before, _KEPT)]

    def made(only: range | None) -> DataFrame:
        """The rows to parse of a group of buckets, as ``snapshot.upsert`` has them."""
        rows = arrived if only is None or len(passes) == 1 else arrived.filter(buckets.bucket_of("record_key", own["buckets"], own.get("hash")).isin([*only]))
        if whole:  # named rows are distinct already
            rows = rows.filter(~unnamed).unionByName(rows.filter(unnamed).dropDuplicates(["record_key"]))
        rows = rows.repartition(tasks, "record_key").withColumn("checksum", permits.checksum(permits.payload(arrived, columns)))
        found = changes(rows if whole else latest(rows), root, tasks, only)
        fresh = found.filter((F.col(_KIND) != snapshot.UNCHANGED) | F.col(_ERROR).isNotNull())
        known = buckets.read(spark, f"{root}/permits", only=only, columns=["record_key", "checksum", *_KEPT])
        if known is None:
            fresh = fresh.withColumns({_STORED: F.lit(None).cast("binary")} | {_before(c): F.lit(None).cast("double") for c in _KEPT})
        else:
            old = known.select("record_key", F.unhex("checksum").alias(_STORED), *[F.col(c).alias(_before(c)) for c in _KEPT])
            fresh = fresh.join(old.repartition(tasks, "record_key"), "record_key", "left")
        parsed = permits.normalize(fresh.select(*[F.col(f"`{c}`") for c in [*columns, *added]]), dataset)
        given = [F.coalesce(F.col(c), F.col(_before(c))).alias(c) if c in _KEPT else F.col(c) for c in parsed.columns if c not in added]
        same = F.coalesce(F.col(_STORED) == F.unhex("checksum"), F.lit(False))
        return parsed.select(*given, *[v.alias(n) for n, v in state.items()], F.col(_KIND).alias("_disposition"), same.alias("_same"))

    # what is stored already, or fails, lies beside the buckets
    schemas = []
    parts = (schemas.append(rows.schema) or rows for rows in map(made, passes))
    laid = buckets.lay(spark, parts, f"{root}/permits", buckets=table_buckets, aside=F.col("error_code").isNotNull() | F.col("_same"))

    done = buckets.laid_rows(spark, laid, schemas[0])
    bad = snapshot.quarantine(done.filter(F.col("bucket") == buckets.ASIDE))[1]
    label = label or f"run={snapshot.newest(spark, f'{root}/seen')[0] + 1}"
    bad.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/failures/{label}")
    count = done.count()
    total = arrived.agg(F.count_if(~unnamed) + F.count_distinct(F.when(unnamed, F.col("record_key"))) if whole else F.count_distinct("record_key")).first()[0]
    counters = snapshot.counters(done.filter("error_code is null").withColumnRenamed("_disposition", "disposition"), bad, skipped=total - count)
    counters = spark.createDataFrame(counters.collect(), counters.schema)  # one line

    if count or laid.own is None:
        buckets.name(spark, laid, done.drop("_disposition", "_same", "bucket").schema, buckets=table_buckets, checkpoint=checkpoint)
        seen = buckets.lay(spark, [done.select(_SEEN)], f"{root}/seen", buckets=table_buckets)
        buckets.name(spark, seen, done.select(_SEEN).schema, buckets=table_buckets, checkpoint=checkpoint)
    buckets.forget_aside(spark, laid)
    buckets.compact(spark, f"{root}/permits")
    buckets.compact(spark, f"{root}/seen")
    return Run(counters, count, laid.filled if laid.own else list(range(table_buckets)))

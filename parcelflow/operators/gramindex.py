"""Substring search over short texts by an index of three-character grams.

The index is a published table in three parts: ``grams`` (gram, key, text), ordered by gram and text, so that a search reads
the row groups of one gram; ``counts`` (gram, n), by which a search takes the rarest gram of what it seeks; and ``texts``
(key, text), each text of a key once. Texts are in lower case. A gram's row carries its text, so that a hit is verified
where it is found; the grams of a text hold it as often as it is long, which suits titles, streets and numbers. Texts beyond
``LONG`` have no grams: every search reads them whole, and searches of one or two characters read all texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshot

SIZE = 3
#: Code points of a text that is indexed, at most.
LONG = 256


def grams(text: Column) -> Column:
    """The distinct grams of a text; none if it is shorter than a gram."""
    starts = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - F.lit(SIZE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(SIZE))))


def build(texts: DataFrame, root: str, key: str = "project_id", text: str = "text") -> int:
    """Publish an index of (key, text) below ``root``; the number of its manifest. Null texts and keys are left out. The
    ranges that are dealt end inside hot grams, as texts are part of the order."""
    spark, folder = texts.sparkSession, f"v-{uuid.uuid4().hex}"
    number, _ = snapshot.newest(spark, root)
    own = texts.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull()).distinct()
    own.withColumn("long", F.length("text") > LONG).repartitionByRange("long", "text").sortWithinPartitions("long", "text").write.parquet(f"{root}/{folder}/texts")
    entries = spark.read.parquet(f"{root}/{folder}/texts").filter(~F.col("long")).select(F.explode(grams(F.col("text"))).alias("gram"), "key", "text")
    entries.repartitionByRange("gram", "text", "key").sortWithinPartitions("gram", "text").write.parquet(f"{root}/{folder}/grams")
    counts = spark.read.parquet(f"{root}/{folder}/grams").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/{folder}/counts")
    snapshot.commit(spark, root, number + 1, {"version": folder})
    return number + 1


def rarest(spark: SparkSession, folder: str, sought: str) -> tuple[str, int] | None:
    """The gram of what is sought that the fewest texts have; nothing if a gram of it stands nowhere. Reads a row for each
    gram of what is sought."""
    wanted = sorted({sought[i : i + SIZE] for i in range(len(sought) - SIZE + 1)})
    found = {r.gram: r.n for r in spark.read.parquet(f"{folder}/counts").filter(F.col("gram").isin(wanted)).collect()}
    return min(((g, found[g]) for g in wanted), key=lambda pair: pair[1]) if len(found) == len(wanted) else None


def search(spark: SparkSession, root: str, sought: str, number: int | None = None) -> DataFrame:
    """(key) of every key with a text that has ``sought`` in it, without case, each once. An empty search finds all keys."""
    own = snapshot.manifest(spark, root, number)
    if own is None:
        raise FileNotFoundError(f"no index in {root}")
    folder, sought = f"{root}/{own['version']}", sought.lower()
    texts, holds = spark.read.parquet(f"{folder}/texts"), F.col("text").contains(sought)
    if len(sought) < SIZE:
        return texts.filter(holds).select("key").distinct()
    hits = texts.filter(F.col("long") & holds).select("key")
    if best := rarest(spark, folder, sought):
        entries = spark.read.parquet(f"{folder}/grams").filter(F.col("gram") == best[0])
        hits = hits.unionByName(entries.filter(holds).select("key"))
    return hits.distinct()

"""Incremental import as a stream: an extension over batch imports, with the same rules for each batch.

Files of raw rows arrive in a folder; every micro-batch is one import run into the bucketed tables, which parses rows that
are new or differ and writes to their buckets alone. A batch that is run again after a failure finds its own rows unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import imports, permits


def import_batch(rows: DataFrame, dataset: permits.Dataset, root: str, batch: int = 0) -> imports.Run:
    """One batch: the latest row of each record (by the source's time of change, then checksum). Failures go to the batch's
    own folder, written anew if the batch is run again."""
    return imports.run(rows, dataset, root, whole=False, label=f"batch={batch}")


def import_stream(spark: SparkSession, folder: str, dataset: permits.Dataset, root: str, checkpoint: str) -> StreamingQuery:
    """Take up what is in ``folder`` now, and stop; the stream's checkpoint remembers the files."""
    rows = spark.readStream.schema(permits.raw_schema(dataset)).json(folder)
    return rows.writeStream.foreachBatch(lambda df, batch: import_batch(df, dataset, root, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised where they lie, dealt to groups by a hash, and each group is packed on its own.
A group's documents are cut into whole sequences and a rest; the rests are packed by first-fit
decreasing, each bin found by descending a tournament tree of the bins' free room. Since documents may
be cut, the fullest bins are then topped up with pieces of the emptiest, and the group's last tokens go
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 2048
#: Documents of a group, on average.
GROUP_DOCUMENTS = 384
#: Groups that one task packs, one after another, on average.
TASK_GROUPS = 256
#: Documents and bytes of ids that a task holds of one group; equal rows may make a group of any size.
HELD_DOCUMENTS, HELD_BYTES = 4096, 64 << 20
#: Bits of a sequence's number within its group.
NUMBER_BITS = 34
SEED = 7

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class TournamentTree:
    """Bins' free room with the greatest of each pair above it; finds the first bin with enough room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.best = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin that has ``size`` left, or -1."""
        best, at = self.best, 1
        if best[1] < size:
            return -1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        return at - self.leaves

    def take(self, i: int, size: int) -> None:
        best, at = self.best, i + self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Items of each bin, by index; items in descending size, ties by index."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins = TournamentTree(len(sizes), room), []
    for i in order:
        b = tree.first(sizes[i])
        while len(bins) <= b:
            bins.append([])
        bins[b].append(i)
        tree.take(b, sizes[i])
    return bins


def pack(lengths: list[int], room: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of each document once.

    Every sequence is ``room`` long or a power of two, so that none needs padding.
    """
    sequences, rests = [], []
    for d, n in enumerate(lengths):
        whole = n - n % room
        sequences += [[(d, at, room)] for at in range(0, whole, room)]
        if n > whole:
            rests.append((d, whole, n - whole))
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    fill = lambda b: sum(p[2] for p in b)
    short = sorted((b for b in bins if fill(b) < room), key=fill)
    sequences += [b for b in bins if fill(b) == room]
    spare = [p for b in short[: len(short) - sum(map(fill, short)) // room] for p in b][::-1]
    for b in short[len(short) - sum(map(fill, short)) // room :]:
        gap = room - fill(b)
        while gap:
            d, at, n = spare.pop()
            b.append((d, at, min(n, gap)))
            if n > gap:
                spare.append((d, at + gap, n - gap))
            gap -= min(n, gap)
        sequences.append(b)
    left = sum(p[2] for p in spare)
    for size in (1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1):
        b = []
        while size:
            d, at, n = spare.pop()
            b.append((d, at, min(n, size)))
            if n > size:
                spare.append((d, at + size, n - size))
            size -= min(n, size)
        sequences.append(b)
    return sequences


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, room: int = SEQUENCE, group_documents: int = GROUP_DOCUMENTS, seed: int = SEED) -> DataFrame:
    """Pack every whole text of ``docs`` (doc_id, text); a row for each piece.

    A null text has the end id alone. Rows that repeat a doc_id are documents of their own; a null doc_id
    stays null in the result. An empty table gives no rows. Other columns are ignored. ``sequence_id`` is
    unique over all groups; ``sequence_tokens`` is the sequence's filled length. Equal rows fall into one group,
    however many: what is held of a group is packed once it reaches ``HELD_DOCUMENTS`` rows or ``HELD_BYTES``.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.count()
    groups = max(1, -(-rows // group_documents))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(groups)).alias("pack"))

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(vocabulary)
        tail = np.array([end_id], own.dtype).tobytes()
        for b in common.batches(stream):
            yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array(b["pack"], pa.int64()), pa.array([v + tail for v in own.encode(b["text"])], pa.binary())], ["doc_id", "pack", "ids"])

    def one(group: int, first: int, ids: list[int | None], values: list[bytes], kind: np.dtype) -> pa.RecordBatch:
        rows = []
        for s, pieces in enumerate(pack([len(v) // kind.itemsize for v in values], room), first):
            at, total = 0, sum(p[2] for p in pieces)
            for d, start, n in pieces:
                own = np.frombuffer(values[d], kind, n, start * kind.itemsize)
                rows.append((ids[d], start, n, zlib.crc32(own.astype("<u4").tobytes()), len(values[d]) // kind.itemsize, group << NUMBER_BITS | s, at, total))
                at += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in SCHEMA.split(", ")])

    def fill(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens.encoder(vocabulary).dtype
        group, first, held, ids, values = None, 0, 0, [], []
        for batch in stream:
            for i, g, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if values and (g != group or len(values) >= HELD_DOCUMENTS or held >= HELD_BYTES):
                    done = one(group, first, ids, values, kind)
                    yield done
                    first = done.column("sequence_id")[-1].as_py() - (group << NUMBER_BITS) + 1 if g == group else 0
                    held, ids, values = 0, [], []
                group = g
                held += len(v)
                ids.append(i)
                values.append(v)
        if values:
            yield one(group, first, ids, values, kind)

    encoded = chosen.mapInArrow(encode, "doc_id long, pack long, ids binary")
    dealt = encoded.repartition(max(common.partitions(spark), -(-groups // TASK_GROUPS)), "pack").sortWithinPartitions("pack", F.asc_nulls_first("doc_id"))
    return dealt.mapInArrow(fill, SCHEMA)

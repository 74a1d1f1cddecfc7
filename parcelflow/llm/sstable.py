"""Token ids as sorted-string-table shards.

Documents are dealt to key ranges, sorted, and each range is written as one shard file in the shared
folder: prefix-compressed blocks, a sparse index of them, a Bloom filter over the keys, and a footer.
``lookup`` finds a document by the filter, a binary search in the index and one block.

File layout (integers little-endian unless said):

* block: entries ``varint shared, varint own, varint value_bytes, own key bytes, value``, then crc32 (4);
  the first entry of a block shares nothing
* index: for each block its last key (9), offset (8) and length (4)
* Bloom filter: number of probes (4), then the bits
* footer: see ``FOOTER``

A key is 9 bytes: 0 for a null identifier or 1, then the identifier big-endian with its sign bit turned,
so that byte order is numeric order. A value is the ids, ``width`` bytes each.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BLOCK_BYTES = 64 * 1024
#: A shard that has grown to so many bytes is closed, and the next one of its range begins.
SHARD_BYTES = 256 << 20
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7
MAGIC = b"PFSSTAB1"
#: documents, ids, bytes per id, blocks, index offset, index length, filter offset, filter length, crc32 of index and filter, magic
FOOTER = struct.Struct("<QQIIQQQQI8s")


def key_bytes(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def key_value(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes one shard to an open stream; holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index, self.keys, self.docs, self.ids = [], [], 0, 0

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_bytes(doc_id)
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(9 - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(data)
            self.index.append(self.last + struct.pack("<QI", self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index, bloom_bytes = b"".join(self.index), struct.pack("<IQ", BLOOM_PROBES, bits) + bloom.tobytes()
        self.out.write(index + bloom_bytes)
        self.out.write(FOOTER.pack(self.docs, self.ids, self.width, len(self.index), self.at, len(index), self.at + len(index), len(bloom_bytes), zlib.crc32(index + bloom_bytes), MAGIC))


class ShardReader:
    """Reads a shard through a seekable file: footer, index and filter at once, blocks when asked."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        self.docs, self.ids, self.width, blocks, at, n, bloom_at, bloom_n, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        file.seek(at)
        meta = file.read(n + bloom_n)
        if magic != MAGIC or zlib.crc32(meta) != crc:
            raise ValueError("not a shard, or a damaged one")
        self.last_keys = [meta[i * 21 : i * 21 + 9] for i in range(blocks)]
        self.places = [struct.unpack("<QI", meta[i * 21 + 9 : i * 21 + 21]) for i in range(blocks)]
        self.bits = struct.unpack("<IQ", meta[n : n + 12])[1]
        self.bloom = meta[n + 12 :]

    def block(self, i: int) -> Iterator[tuple[int | None, bytes]]:
        at, n = self.places[i]
        self.file.seek(at)
        data = self.file.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        pos, key = 0, b""
        while pos < n - 4:
            shared, pos = _read_varint(data, pos)
            own, pos = _read_varint(data, pos)
            size, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + own]
            pos += own
            yield key_value(key), data[pos : pos + size]
            pos += size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_bytes(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of every entry with the key."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_bytes(doc_id), []
        i = bisect.bisect_left(self.last_keys, key)
        while i < len(self.places):
            entries = list(self.block(i))
            found += [v for k, v in entries if k == doc_id]
            if self.last_keys[i] != key:
                break
            i += 1
        return found


_NULL_KEY = -(1 << 63)


def _shard_of(doc_id: int | None, points: np.ndarray, salt: int) -> int:
    """The range of a key. A key that fills whole ranges (its bound stands there twice or more) is dealt among these: they
    hold no other key, so that the order of ranges stays that of keys."""
    key = _NULL_KEY if doc_id is None else doc_id
    low, high = (int(np.searchsorted(points, key, side)) for side in ("left", "right"))
    return high if high - low < 2 else low + 1 + salt % (high - low)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the shards of each range of ``doc_id``.

    Returns the manifest, checkpointed: shard (the range's number, then the shard's in it), path, first and last doc_id,
    docs, ids. Null text: no ids but the end id. Null doc_id: the null key, before all others. Repeated rows: an entry
    each; rows of one key may lie in several shards that follow one another. An empty table: no shards. Other columns are
    ignored. A shard is closed at ``shard_bytes``, written under a name of its attempt and then renamed, so that a repeated
    or lost task leaves one whole file.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shards or common.partitions(spark)
    points = np.array(common.range_bounds(docs.select(F.coalesce("doc_id", F.lit(_NULL_KEY)).alias("doc_id")), "doc_id", n), np.int64)

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(vocabulary)
        tail = np.array([end_id], own.dtype).tobytes()
        for b in common.batches(stream):
            ids = [v + tail for v in own.encode(b["text"])]
            shard = [_shard_of(i, points, zlib.crc32(v)) for i, v in zip(b["doc_id"], ids)]
            yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array(shard, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "shard", "ids"])

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = common.filesystem(folder)
        width = tokens.encoder(vocabulary).width
        attempt = TaskContext.get().taskAttemptId()
        shard, part, writer, first, last, rows = None, 0, None, None, None, []

        def close() -> None:
            writer.close()
            writer.out.close()
            name = f"shard-{shard:06d}-{part:06d}.sst"
            fs.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            rows.append((shard << 32 | part, f"{folder}/{name}", first, last, writer.docs, writer.ids))

        fs.create_dir(root, recursive=True)
        for batch in stream:
            for doc_id, s, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if writer is None or s != shard or writer.at >= shard_bytes:
                    if writer:
                        close()
                    shard, part, first = s, part + 1 if s == shard else 0, doc_id
                    writer = ShardWriter(fs.open_output_stream(f"{root}/.shard-{shard:06d}-{part:06d}.sst-{attempt}"), width)
                writer.add(doc_id, ids)
                last = doc_id
        if writer:
            close()
        names = ["shard", "path", "first_id", "last_id", "docs", "ids"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    encoded = docs.mapInArrow(encode, "doc_id long, shard int, ids binary")
    dealt = encoded.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"))
    return common.checkpointed(dealt.mapInArrow(write, "shard long, path string, first_id long, last_id long, docs long, ids long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every entry of the shards, read block by block: doc_id, start (ids before it in doc_id order), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), shard, and the ids themselves."""
    spark = manifest.sparkSession
    shards = sorted(manifest.select("shard", "path", "ids").collect())  # a row for each shard file
    before, total = [], 0
    for r in shards:
        before.append((r.shard, r.path, total))
        total += r.ids
    if not before:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            for shard, path, start in zip(b["shard"], b["path"], b["before"]):
                fs, name = common.filesystem(path)
                with fs.open_input_file(name) as file:
                    reader = ShardReader(file, file.size())
                    kind = np.dtype(f"<u{reader.width}")
                    for i in range(len(reader.places)):
                        rows = []
                        for doc_id, value in reader.block(i):
                            ids = np.frombuffer(value, kind)
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        columns = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([shard] * len(rows), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    tasks = spark.createDataFrame(before, "shard long, path string, before long").repartition(min(len(before), common.partitions(spark)))
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids): every entry of the wanted documents (doc_id), by the shards' ranges of keys, Bloom filters, index
    search and one block each. Null identifiers find the entries of the null key. Other columns are ignored."""
    keyed = lambda c: F.coalesce(F.col(c), F.lit(_NULL_KEY))
    spans = [tuple(r) for r in manifest.select(keyed("first_id"), keyed("last_id"), "path").collect()]  # a row for each shard file
    if not spans:
        return wanted.sparkSession.createDataFrame([], "doc_id long, ids array<long>")
    spans.sort()
    firsts, lasts, paths = [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]

    def find(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            by_path: dict[str, list[int | None]] = {}
            for doc_id in b["doc_id"]:
                key = _NULL_KEY if doc_id is None else doc_id
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    by_path.setdefault(paths[i], []).append(doc_id)
            for path, ids in by_path.items():
                fs, name = common.filesystem(path)
                with fs.open_input_file(name) as file:
                    reader = ShardReader(file, file.size())
                    rows = [(i, np.frombuffer(v, f"<u{reader.width}").tolist()) for i in ids for v in reader.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return wanted.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(find, "doc_id long, ids array<long>")

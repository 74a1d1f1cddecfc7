import io
import zlib

import numpy as np
import pytest

from parcelflow.llm import common, sstable, tokens


def shard(entries, **kw) -> bytes:
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, 2, **kw)
    for doc_id, value in entries:
        writer.add(doc_id, value)
    writer.close()
    return out.getvalue()


def test_shard_round_trip_lookup_and_damage():
    entries = [(None, b"ab")] + [(i * i - 500, bytes([i, 0]) * i) for i in range(40)] + [(10_000, b"xy"), (10_000, b"zz")]
    entries = [entries[0], *sorted(entries[1:], key=lambda e: e[0])]
    data = shard(entries, block_bytes=50)
    reader = sstable.ShardReader(io.BytesIO(data), len(data))
    assert list(reader) == entries and len(reader.places) > 3
    assert reader.get(10_000) == [b"xy", b"zz"] and reader.get(None) == [b"ab"] and reader.get(10_001) == []
    assert all(v in reader.get(k) for k, v in entries)
    broken = bytearray(data)
    broken[3] ^= 1
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(bytes(broken)), len(data)))


def test_files_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    rows = [(30, "b c"), (-5, None), (7, ""), (7, "again"), (2**40, "word " * 3000), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    manifest = sstable.write_shards(docs, common.shared_path(spark, "sst"), tokens.default_vocabulary(), 2, shards=3)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == [None, -5, 7, 7, 30, 2**40]
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 in [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids[r.doc_id]]
        at += r.n_tokens
    found = {r.doc_id: r.ids for r in sstable.lookup(manifest, spark.createDataFrame([(30,), (31,), (None,)], "doc_id long")).collect()}
    assert found == {30: ids[30][0], None: ids[None][0]}


def test_a_hot_key_is_dealt_among_shards_in_order(spark):
    rows = [(i, f"w{i}") for i in range(40)] + [(17, f"hot {i}") for i in range(160)] + [(None, f"none {i}") for i in range(90)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, shard string, ids string")
    manifest = sstable.write_shards(docs, common.shared_path(spark, "sst"), tokens.default_vocabulary(), 2, shards=12, shard_bytes=300)
    files = sorted(manifest.collect())
    assert sum(r.docs for r in files) == len(rows) and max(r.docs for r in files) < 80
    assert sum(r.first_id == r.last_id == 17 for r in files) > 2 and sum(r.last_id is None for r in files) > 1
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    found = sstable.lookup(manifest, spark.createDataFrame([(17,), (3,), (99,), (None,)], "doc_id long")).collect()
    assert sorted(str(r.doc_id) for r in found) == ["17"] * 161 + ["3"] + ["None"] * 90
    assert len({tuple(r.ids) for r in found}) == 252


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sstable.read_shards(sstable.write_shards(empty, common.shared_path(spark, "sst"), tokens.default_vocabulary(), 2)).collect() == []

"""Texts of several million characters, whole, by the operators whose other tests have short ones."""

import hashlib

from parcelflow.llm import chat, common, lines, media, pieces, sstable, tokens

LONG = "Some words of a very long text, again and again. " * 200_000
SCHEMA = "doc_id long, text string"


def test_media(spark):
    (got,) = media.read_features(media.store_texts(spark.createDataFrame([(1, LONG)], SCHEMA))).collect()
    n, payload = media.payload(LONG)
    assert got.n_bytes == n == len(LONG) and got.payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_chat(spark):
    text = LONG + "[/INST]</s>" + "\\" * 1000
    df = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string")
    (got,) = chat.digest(chat.format_turns(df)).collect()
    assert got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_lines(spark):
    text = "menu\n" + LONG + "\nmenu\n" + "x\n" * 20_000
    docs = spark.createDataFrame([(1, "menu", "a"), (2, text, "b"), (3, "menu", "c")], f"{SCHEMA}, source string")
    got = {r.doc_id: r.text for r in lines.clean(docs, min_sites=3).collect()}
    assert got[1] == "menu" and got[2] == LONG + "\n" + "x\n" * 20_000


def test_shards(spark):
    docs = spark.createDataFrame([(1, "a"), (2, LONG), (3, "b")], SCHEMA)
    got = {r.doc_id: r for r in sstable.read_shards(sstable.write_shards(docs, common.shared_path(spark, "long"), tokens.default_vocabulary(), 2)).collect()}
    assert got[2].n_tokens > 2_000_000 and got[3].start == got[2].start + got[2].n_tokens


def test_pieces(spark):
    (got,) = pieces.encode(spark.createDataFrame([(1, LONG[:500_000])], SCHEMA), pieces.default_model()).collect()
    assert got.round_trip and len(got.ids) > 150_000

import random
import zlib

import numpy as np

from parcelflow.llm import packing, tokens


def test_tree_finds_the_first_fit():
    draw = random.Random(2)
    for _ in range(50):
        sizes = [draw.randint(1, 20) for _ in range(draw.randint(1, 40))]
        bins: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for b in bins:
                if sum(sizes[j] for j in b) + sizes[i] <= 20:
                    b.append(i)
                    break
            else:
                bins.append([i])
        assert packing.first_fit_decreasing(sizes, 20) == bins


def test_every_token_once_and_no_padding():
    draw = random.Random(3)
    for _ in range(60):
        lengths = [draw.choice([1, 2, 63, 64, 65, draw.randint(1, 300)]) for _ in range(draw.randint(1, 30))]
        sequences = packing.pack(lengths, 64)
        seen = sorted((d, i) for s in sequences for d, at, n in s for i in range(at, at + n))
        assert seen == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
        assert all(sum(p[2] for p in s) == 64 or sum(p[2] for p in s).bit_count() == 1 for s in sequences)


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    rows = [(1, "Hello, world! it's 5"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (None, "<|endoftext|> x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sequence_id int")
    got = packing.pack_documents(docs, tokens.default_vocabulary(), group_documents=2).collect()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id or 0, len(ids), ids))
    for doc_id, n, ids in want:
        own = sorted((r for r in got if (r.doc_id or 0) == doc_id), key=lambda r: r.start)
        assert all(r.doc_tokens == n and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
        assert sum(r.length for r in own) == n * sum(1 for w in want if w[0] == doc_id)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), tokens.default_vocabulary()).collect() == []


def test_memoised_ids_are_the_library_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokens.default_vocabulary()), tokens.encoder(tokens.default_vocabulary())
    draw = random.Random(6)
    texts = ["", None, "ÀÉ ß x", "don't  'll", "a" * 200, "日本語 テキスト", "\0\x01 x", "é", "<|startoftext|>"] + ["".join(draw.choice("abé ,.'!9\n\tZ😀") for _ in range(60)) for _ in range(200)]
    assert [np.frombuffer(v, own.dtype).tolist() for v in own.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_rules_have_texts_encoded_whole():
    import copy
    import json

    own = tokens.ChunkEncoder(tokens.default_vocabulary())
    rules = json.loads(own.tokenizer.to_str())
    assert own.chunked and tokens.cuts_at_blanks(rules)
    for change in (
        lambda r: r["normalizer"]["normalizers"].pop(1), lambda r: r.update(normalizer=None), lambda r: r.update(pre_tokenizer=None), lambda r: r["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
        lambda r: r["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\s?[\p{L}]+|[^\s\p{L}\p{N}]+"), lambda r: r["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True), lambda r: r["model"].update(end_of_word_suffix=None),
    ):
        other = copy.deepcopy(rules)
        change(other)
        assert not tokens.cuts_at_blanks(other)
    texts = ["Hello  there", None, "a\nb"]
    chunked = own.encode(texts)
    own.chunked = False
    assert own.encode(texts) == chunked


def test_one_very_long_document(spark):
    text = "some words of a very long document, again and again. " * 40_000
    got = packing.pack_documents(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), tokens.default_vocabulary()).collect()
    own = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    assert own[0].doc_tokens == sum(r.length for r in own) > 400_000 and [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]


def test_equal_rows_of_any_number_are_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD_DOCUMENTS", 50)
    rows = [(7, "the same words again")] * 1000 + [(i, f"other {i}") for i in range(100, 160)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokens.default_vocabulary(), room=32).collect()
    assert sum(r.length for r in got if r.doc_id == 7) == 1000 * next(r.doc_tokens for r in got if r.doc_id == 7)
    assert {r.doc_id for r in got} == {7, *range(100, 160)}
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= 32 for n in filled.values()) and all(filled[r.sequence_id] == r.sequence_tokens for r in got)

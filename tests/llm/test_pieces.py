import random

from parcelflow.llm import pieces


def best_path(word: str, table: dict, byte_ids: list[int], lowest: float) -> list[int]:
    best = [(0.0, 0, 0, [])]
    for z in range(1, len(word) + 1):
        found = []
        for a in range(max(0, z - 16), z):
            if word[a:z] in table:
                score, i = table[word[a:z]]
                found.append((best[a][0] + score, a, i, best[a][3] + [i]))
        if word[z - 1] not in table:
            raw = word[z - 1].encode()
            found.append((best[z - 1][0] + (lowest - pieces.BYTE_PENALTY) * len(raw), z - 1, -1, best[z - 1][3] + [byte_ids[b] for b in raw]))
        best.append(max(found, key=lambda f: f[:3]))
    return best[-1][3]


def test_paths_against_brute_force_and_round_trip(spark):
    draw = random.Random(1)
    texts = [None, "", " ", "hello world the quick", "a" * 100, "a  b", "▁▁ x", "\0", "日本語 text"] + ["".join(draw.choice("abc .,é😀\n▁xthein") for _ in range(draw.randint(0, 40))) for _ in range(50)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(3, texts[3], "extra"), (None, "null id", "extra")]
    model = pieces.default_model()
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), model).collect()
    assert len(got) == len(rows)
    own = pieces._model(model)
    table = {own.id_to_piece(i): (own.get_score(i), i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))}
    lowest, byte_ids = min(s for s, _ in table.values()), pieces.byte_ids(model)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "null id"
        assert r.ids == [i for w in pieces.words(text) for i in best_path(w, table, byte_ids, lowest)]
        assert r.n_pieces == len(r.ids) and r.round_trip is ("▁" not in (text or ""))


def test_no_piece_spans_a_cut():
    cut = pieces.cutter(pieces.default_model())
    own = pieces._model(pieces.default_model())
    inside = {p[i : i + 2] for p in map(own.id_to_piece, range(own.get_piece_size())) for i in range(len(p) - 1)}
    words = ["▁hello.", "▁x=%%%y", "日本", "a", "▁", "▁😀é"]
    parts, counts = cut.parts(words)
    assert "".join(parts) == "".join(words) and counts.sum() == len(parts)
    for word, end in zip(words, counts.cumsum()):
        own_parts = parts[end - counts[words.index(word)] : end]
        assert "".join(own_parts) == word
        assert own_parts == [p for i, p in enumerate(own_parts)] and all(a[-1] + b[0] not in inside for a, b in zip(own_parts, own_parts[1:]))


def test_bare_words_are_the_words():
    for text in ("", " ", "  ", "a b", " a", "a ", "a  b", "a▁b", "a \n b", "a  "):
        assert [pieces.MARK + w for w in pieces.bare_words(text)] == pieces.words(text)


def test_blocks_and_splits_of_any_size_give_the_same(spark, tmp_path):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["alpha", "beta,", "gamma\ndelta", "ε", "x" * 70]) for _ in range(draw.randint(0, 30))) for _ in range(600)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 2048).parquet(str(tmp_path / "docs"))
    model = pieces.default_model()
    docs = spark.read.parquet(str(tmp_path / "docs"))
    one = sorted(map(tuple, pieces.encode(docs, model, with_ids=False).collect()))
    assert len(one) == len(texts) and all(r[4] for r in one)
    small = pieces.encode(docs, model, from_files=True, with_ids=False, block_rows=37)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "3000")  # the second scan is split otherwise than the first
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert sorted(map(tuple, small.collect())) == one
        assert docs.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), pieces.default_model()).collect() == []


def test_long_runs_are_not_cut(spark):
    draw = random.Random(2)
    texts = ["https://example.org/international/" + "understanding" * 9, "internationalization" * 30, " " * 150 + "x", "信息处理" * 40]
    texts += ["".join(draw.choice("etaoinshrdlu") for _ in range(n)) for n in (33, 64, 65, 400)] + ["one\ntwo\nthree\n" * 12]
    model = pieces.default_model()
    own = pieces._model(model)
    table = {own.id_to_piece(i): (own.get_score(i), i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))}
    lowest, byte_ids = min(s for s, _ in table.values()), pieces.byte_ids(model)
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert max(map(len, table)) <= 16 and len(got) == len(texts)
    for r in got:  # the path of the whole escaped text, without any cut
        assert r.ids == best_path(pieces.MARK + texts[r.doc_id].replace(" ", pieces.MARK), table, byte_ids, lowest)
        assert r.round_trip


def test_a_lost_table_of_paths_is_an_error(spark, monkeypatch, tmp_path):
    import shutil

    import pytest

    made = []
    own = pieces.common.shared_path
    monkeypatch.setattr(pieces.common, "shared_path", lambda s, kind: made.append(own(s, kind)) or made[-1])
    docs = spark.createDataFrame([(1, "some words"), (2, "x" * 5000), (3, "")], "doc_id long, text string")
    out = pieces.encode(docs, pieces.default_model())
    assert len(out.collect()) == 3
    (lost,) = [p.removeprefix("file://") for p in made if "/paths-" in p]
    shutil.move(lost, tmp_path / "moved")
    with pytest.raises(Exception, match="not whole"):
        out.collect()


def test_words_of_a_batch_are_those_of_each_text():
    import pyarrow as pa

    texts = ["é a", None, "", "  ", "a▁b", "plain words", " x", "y  z ", "last one "] * 3
    for a, z in ((0, 27), (5, 19), (1, 2), (4, 4)):
        got = pieces.split(pa.array(texts, pa.string()).slice(a, z - a))
        assert [w or [] for w in got.to_pylist()] == [pieces.bare_words(t) for t in texts[a:z]]
        assert got.values.to_pylist() == [w for t in texts[a:z] for w in pieces.bare_words(t)]


def test_a_block_of_many_words_writes_each_part_once(spark):
    from pyspark.sql import functions as F

    ends = [a + b for a in "tshrnl" for b in "aeiou"]
    word = F.concat(F.conv("id", 10, 30), *[F.element_at(F.array(*map(F.lit, ends)), (F.floor(F.col("id") / 30**k) % 30 + 1).cast("int")) for k in range(2)])
    rows = spark.range(620_000).select(F.floor(F.col("id") / 10_000).alias("doc_id"), word.alias("w")).groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("w")).alias("text"))
    own = pieces._parts_of(rows.coalesce(1).select(F.lit(1).cast("long").alias("block"), "text"), pieces.default_model()).cache()
    assert own.count() == own.distinct().count() > 0
    own.unpersist()

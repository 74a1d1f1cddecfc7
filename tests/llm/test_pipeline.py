"""The whole pipeline on a small corpus with planted cases, each stage against a plain version of its rule."""

import gc
import random
import tracemalloc
import zlib

import numpy as np

import corpus_pipeline
from parcelflow.llm import common, simhash, suffixes, tokens


def corpus(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = [f"w{i}x{draw.randrange(999)}" for i in range(3000)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        text = prose(120) + (" scum filth vermin" if toxic else "")
        rows.append((i, f"{text}\nAll rights reserved here", "en", f"s{i % 14}"))
        labels.append((i, 1, int(toxic)))
    passage = prose(100)
    clean = [i for i in range(160) if i % 4]
    for i in clean[:2]:
        rows[i] = (i, f"{prose(60)} {passage} {prose(60)}\nAll rights reserved here", "en", rows[i][3])
    rows += [(200, rows[clean[5]][1], "en", "s1"), (201, "head " + rows[clean[6]][1], "en", "s2"), (300, None, None, None), (301, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.selectExpr("*", "cast(length(text) as bigint) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, passage, clean


def test_stages_in_turn(spark, tmp_path):
    rows, passage, clean = corpus(spark, tmp_path)
    docs, kept = common.documents(spark, str(tmp_path)), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        docs, kept[name] = out, {r.doc_id: r.text for r in out.collect()}
    toxic = {r[0] for r in rows if "vermin" in (r[1] or "")}
    assert toxic and not toxic & set(kept["toxicity"]) and set(kept["toxicity"]) == {r[0] for r in rows} - toxic
    assert sum("All rights" in (t or "") for t in kept["line_dedup"].values()) == 1
    near = set(kept["simhash_near_dedup"])
    assert {200, 201} & near == set() and set(clean) <= near and len({300, 301} & near) == 1
    assert not any(passage[:400] in (t or "") for t in kept["suffix_array_dedup"].values()) and set(kept["suffix_array_dedup"]) == near
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == near and all(r.length > 0 for r in final)
    assert zlib.crc32(b"") == 0 and sum(r.length for r in final) == sum({r.doc_id: r.doc_tokens for r in final}.values())


def test_repeat_stage_takes_passages_of_51_words(spark, tmp_path):
    draw = random.Random(14)
    prose = lambda n: " ".join(str(draw.randrange(1000, 9999)) for _ in range(n))
    passage = prose(51)
    assert len(passage) < 400
    rows = [(i, f"{prose(80)} {passage} {prose(80)}", "en", "s", 0) for i in range(2)] + [(2, prose(90), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeat_stage(spark, docs, str(tmp_path)).collect()}
    assert [got[i] for i in range(3)] == [rows[0][1].replace(passage, ""), rows[1][1].replace(passage, ""), rows[2][1]]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_by_fingerprint(spark, tmp_path):
    """A text that repeats itself and one with a tail of other words: fingerprints weigh repeats, sets of shingles do not."""
    unit = "a b c d e f g "
    one, two = (unit * 40).strip(), (unit * 40 + " ".join(f"{w}{i}" for i, w in enumerate("stuvwxyz"))).strip()
    assert (simhash.fingerprint(one) ^ simhash.fingerprint(two)).bit_count() <= 3
    assert len(np.intersect1d(simhash.shingle_set(one), simhash.shingle_set(two))) / len(np.union1d(simhash.shingle_set(one), simhash.shingle_set(two))) < 0.8
    docs = spark.createDataFrame([(4, one, "en", "s", 0), (9, two, "en", "s", 0), (11, "quite another text", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()) == [4, 11]


def test_what_a_worker_remembers_does_not_add_up_by_stage():
    own = tokens.encoder(tokens.default_vocabulary())
    texts = [" ".join(f"{chr(97 + i % 26)}{i * 500 + j:x}" for j in range(500)) for i in range(300)]  # 150,000 words
    before = simhash.shingle_set(texts[0]), suffixes.word_bytes(texts[0]), own.encode(texts[:1])
    tracemalloc.start()
    try:
        held = []
        for step in (simhash.shingle_set, suffixes.word_bytes, lambda t: own.encode([t]), suffixes.word_bytes):
            for text in texts:
                step(text)
            gc.collect()
            held.append(tracemalloc.get_traced_memory()[0] / 1e6)
    finally:
        tracemalloc.stop()
    assert held[0] < 10 and held[1] < 10 and held[3] < 10 < held[2], held  # MB: few words, or many chunks until the next kind
    after = simhash.shingle_set(texts[0]), suffixes.word_bytes(texts[0]), own.encode(texts[:1])
    assert (before[0] == after[0]).all() and before[1:] == after[1:]

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import queries, toxicity


def test_folding():
    assert toxicity.fold("Ｙоu 1D10T, sh!t 2024") == " you idiot shit 2024 "
    assert toxicity.fold(None) == "  " and toxicity.fold("​bad​word") == " badword "


def test_hits_heaviest_of_each_word_and_exceptions():
    own = toxicity.Lexicon({" bad ": 3.0, " bad": 2.0, " idio": 2.5}, ["not bad"])
    assert [h[3] for h in own.hits(toxicity.fold("bad baddest idiotic"))] == [" bad ", " bad", " idio"]
    assert own.hits(toxicity.fold("it is not bad")) == [] and own.score("") == own.score(None)
    assert own.score("bad bad") > own.score("bad " + "fine " * 50) > own.score("fine")


def naive_hits(own, folded: str) -> list[tuple]:
    """Every entry at every place; the heaviest of those that start together, unless one phrase covers it."""
    best, covers = {}, []
    for phrase in own.exceptions:
        covers += [(i, i + len(phrase) + 2) for i in range(len(folded)) if folded.startswith(f" {phrase} ", i)]
    for i in range(len(folded)):
        found = [(w, e) for e, w in own.weights.items() if folded.startswith(e, i)]
        if found:
            top = max(w for w, _ in found)
            best[i] = (i, top, {e for w, e in found if w == top})
    return [(i, w, es) for i, w, es in best.values() if any(not any(a <= i and i + len(e) <= b for a, b in covers) for e in es)]


def test_automaton_against_a_naive_search():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(1, 6)))
    for _ in range(200):
        entries = {draw.choice([f" {w} ", f" {w}"]): draw.random() for w in (word() for _ in range(12))}
        own = toxicity.Lexicon(entries, sorted({f"{word()} {word()}" for _ in range(6)}))
        folded = toxicity.fold(" ".join(word() for _ in range(draw.randint(0, 40))))
        got = own.hits(folded)
        want = naive_hits(own, folded)
        assert [(h[0], h[2]) for h in got] == [(i, w) for i, w, _ in want]
        assert all(h[3] in es for h, (_, _, es) in zip(got, want))


def test_long_and_repeated_texts(spark):
    own = toxicity.Lexicon({" bad ": 3.0}, ["not bad", "so not"])
    text = "so not bad " * 200_000 + "bad"
    assert len(own.hits(toxicity.fold(text))) == 1
    got = toxicity.score(spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "bad", "y")], "doc_id long, text string, entry string"), own).collect()
    assert got[0] == got[1] and got[2].score > got[0].score and [r.n_hits for r in got] == [1, 1, 1] and got[2].entry == "bad"


def test_one_label_or_none_gives_a_constant_score(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for l in (labels, labels.limit(0)):
        got = toxicity.score(docs.withColumn("score", F.lit("x")), toxicity.fit_from_labels(docs, l)).collect()
        assert len(got) == 3 and len({r.score for r in got}) == 1
    assert toxicity.score(docs.limit(0), toxicity.Lexicon({})).collect() == []


def test_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert 300 < toxicity.sample_labels(labels, 500).count() <= 500 and toxicity.sample_labels(labels, 5000).count() == 5000


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no tables here")
    got = queries.op1_toxicity(spark, folder)
    known = got.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in known) / len(known) > 0.9
    assert all(0 <= r.score <= 1 for r in known) and got.count() == 1000

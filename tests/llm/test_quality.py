import random

import numpy as np
from pyspark.sql import functions as F

from parcelflow.llm import quality, toxicity


def corpus(n=400, seed=3):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghik") for _ in range(draw.randrange(2, 8))) for _ in range(500)]
    rows = []
    for i in range(n):
        own = [draw.choice(words) for _ in range(draw.randrange(30, 90))]
        kind = i % 5
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in own)
        elif kind == 1 and i % 2:
            text = " ".join([own[0]] * len(own))
        else:
            text = " ".join(own).capitalize() + "."
        rows.append((i, text, int(not (kind == 0 or (kind == 1 and i % 2)))))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 9.5) for i, t, _ in rows], "doc_id long, text string, quality string, score double")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_whole_results(spark):
    rows = corpus()
    docs, labels = frames(spark, rows + [(900, None, 1), (901, "", 1), (902, "word " * 300_000, 0), (903, rows[2][1], 1)])
    model = quality.fit(quality.sample(docs, labels))
    found = {r.doc_id: r for r in quality.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    assert len(found) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    held = [(r[2], found[r[0]].predicted) for r in rows if found[r[0]].held]
    assert np.mean([a == b for a, b in held]) > 0.95 and len(held) > 50
    assert found[900].score == found[901].score and found[903].score == found[2].score


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = frames(spark, corpus(200))
    turned = labels.withColumn("quality", F.when(toxicity.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(quality.sample(docs, x)) for x in (labels, turned))
    assert np.array_equal(one.vectors, two.vectors) and one.curve == two.curve


def test_votes_are_those_of_a_plain_search(spark):
    docs, labels = frames(spark, corpus(200))
    model = quality.fit(quality.sample(docs, labels))
    texts = [t for _, t, _ in corpus(60, seed=8)]
    vectors = model.latent(texts)
    for v, got in zip(vectors, model.votes(vectors)):
        near = sorted(((float(v @ w), y) for w, y in zip(model.vectors, model.labels)), key=lambda x: -x[0])[: quality.NEIGHBOURS]
        weights = [max(s, 1e-6) ** quality.POWER for s, _ in near]
        assert abs(got - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-3


def test_sample_is_bounded_and_one_label_scores_half(spark):
    docs, labels = frames(spark, corpus(100))
    assert quality.sample(docs, labels, rows=20).count() <= 20
    model = quality.fit(quality.sample(docs, labels.filter("quality = 1")))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_forms():
    assert [quality.form(t) for t in ("Some***", "WORD!!!!!", "a1b22", "|", "été,")] == ["Aa***", "A!!!", "a0a0", "|", "a,"]

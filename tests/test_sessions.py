"""Sessions in two levels against the plain windows, and how evenly a hot key is dealt."""

import datetime
import random

from pyspark.sql import functions as F

from parcelflow.operators import episode

DAY0 = datetime.datetime(2020, 1, 1)


def events(spark, seed=1, n=900):
    draw, rows = random.Random(seed), []
    for i in range(n):
        key = "hot" if i % 2 else draw.choice(["a", "b", "c", None])
        start = None if draw.random() < 0.02 else DAY0 + datetime.timedelta(minutes=draw.randrange(40_000))
        rows.append((key, start, start and start + datetime.timedelta(minutes=draw.choice([0, 5, 3000])), i))
    rows += [("one", DAY0, DAY0, 10_000), ("ties", DAY0, DAY0, 10_001), ("ties", DAY0, DAY0, 10_002)]
    return spark.createDataFrame(rows, "key string, start timestamp, end timestamp, id long")


def test_slices_give_the_same_sessions(spark):
    own, gap = events(spark), F.expr("interval 45 minutes")
    want = {r.id: r.episode for r in episode.sessions(own, "key", "start", "end", gap, ["id"]).collect()}
    for slices in (1, 2, 7, 64):
        got = {r.id: r.episode for r in episode.sliced_sessions(own, "key", "start", "end", gap, ["id"], slices).collect()}
        assert got == want, slices
    assert episode.sliced_sessions(own.limit(0), "key", "start", "end", gap, ["id"]).collect() == []


def test_a_hot_key_is_dealt_evenly(spark):
    own = episode.sliced_sessions(events(spark, n=4000), "key", "start", "end", F.expr("interval 45 minutes"), ["id"], 32)
    sizes = sorted(r["count"] for r in own.filter("key = 'hot'").groupBy("_slice").count().collect())
    assert len(sizes) > 30 and sizes[-1] < 2.5 * sizes[len(sizes) // 2]


def assessed(spark, seed=2, n=600):
    draw, rows = random.Random(seed), []
    for i in range(n):
        project = "hot" if i % 2 else draw.choice(["p", "q", "r", None] + [f"s{k}" for k in range(30)])
        undated = project in ("r", "s3") or draw.random() < 0.1
        start = None if undated else datetime.date(1990, 1, 1) + datetime.timedelta(days=draw.randrange(9000))
        end = start and start + datetime.timedelta(days=draw.choice([0, 20, 900]))
        event_date = draw.choice([None, start, datetime.date(2000, 1, 1)])
        rows.append((f"e{i:04}", project, draw.choice(["PRINCIPAL_RESIDENTIAL", "EXCLUDED", "PROPERTY_ONLY", "PRINCIPAL_DEMOLITION"]), start, end, event_date))
    own = spark.createDataFrame(rows, "event_id string, project_id string, role string, source_start date, source_end date, event_date date")
    return own.withColumn("ordering_date", F.col("source_end").cast("timestamp"))


def test_slices_give_the_same_latest_episode(spark):
    for seed in (2, 3):
        own = assessed(spark, seed)
        names = ["event_id", "project_id", "episode", "episode_start", "episode_end", "position"]
        dated = F.when(F.col("ordering_date").isNotNull(), F.col("episode")).alias("episode")  # undated events have no number that counts
        rows = lambda df: sorted((tuple(r) for r in df.select(*names[:2], dated, *names[3:]).collect()), key=repr)
        want = rows(episode.latest_episode(own))
        for slices in (1, 5, 64):
            assert rows(episode.latest_episode(own, slices=slices)) == want, (seed, slices)

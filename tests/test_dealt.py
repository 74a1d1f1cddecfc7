"""What one task holds does not grow with the table: rows are dealt by their number, not by the session's partitions."""

import pytest
from pyspark.sql import functions as F

from parcelflow import session
from parcelflow.operators import project, readmodel
from parcelflow.plans import binding, ingest_queries, project_queries
from parcelflow.sources import buckets, imports

DATA = "/root/testdata/sf0.001"  # 1,500 orders


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("made", [
    lambda spark: project.states(binding.permits(spark, DATA), ascii_only=True),
    lambda spark: project_queries.classify_score(spark, DATA),
    lambda spark: project_queries.episodes_orders(spark, DATA),
    lambda spark: readmodel.latest_events(session.dealt(binding.permits(spark, DATA), "project_id")),
])
def test_more_rows_are_more_tasks(spark, monkeypatch, made):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    assert tasks(made(spark)) > 20


def test_dealt_keeps_rows_and_keys_together(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = spark.range(1000).select(F.when(F.col("id") % 97 > 0, F.col("id") % 97).alias("k"), "id")
    got = session.dealt(rows, "k").withColumn("p", F.spark_partition_id())
    assert got.count() == 1000 and got.groupBy("k").agg(F.countDistinct("p").alias("n")).filter("n > 1").isEmpty()
    assert session.dealt(rows.limit(0), "k").count() == 0


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


@pytest.mark.parametrize("made", [
    lambda spark: project.states(binding.permits(spark, DATA), ascii_only=True),
    lambda spark: project_queries.policy_preview(spark, DATA),
])
def test_no_window_sorts_joined_texts_or_milestones(spark, made):
    windows = [n for n in _nodes(made(spark)._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    carried = [[a.name() for a in map(own.apply, range(own.size())) if a.dataType().typeName() == "array"] for own in (w.children().apply(0).output() for w in windows)]
    assert len(windows) >= 5 and not any(carried), carried


def test_hot_keys_signals_are_computed_once(spark):
    plan = project_queries.episodes_hot_key(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "Generate" not in plan  # they lie in the shared folder


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("record_key"), F.col("id").alias("v"))
    folder, filled = buckets._write(rows, str(tmp_path), "base", "record_key", 2)
    assert filled == [0, 1] and all(len(list((tmp_path / folder / f"bucket={b}").glob("*.parquet"))) > 5 for b in filled)
    buckets.create(rows, f"{tmp_path}/t", buckets=2)
    buckets.merge(spark.createDataFrame([("7", -7), ("x", 1)], "record_key string, v long"), f"{tmp_path}/t", lambda old, new: new)
    got = {tuple(r) for r in buckets.read(spark, f"{tmp_path}/t").collect()}
    assert got == {(str(i), i) for i in range(1000) if i != 7} | {("7", -7), ("x", 1)}


def test_rows_without_identifier_that_are_equal_fail_once(spark, tmp_path):
    raw = ingest_queries.raw_building(spark, DATA).limit(300).cache()
    unnamed = raw.filter("row_id is null")
    done = imports.run(raw.unionByName(unnamed), ingest_queries.DATASET, str(tmp_path), table_buckets=2).counters.first()
    alone = imports.run(raw, ingest_queries.DATASET, f"{tmp_path}/alone", table_buckets=2).counters.first()
    assert unnamed.count() > 0 and done == alone and done.failed > 0

"""Benchmarks kept for other sessions, group counts for the portfolio, and previews of policies."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from parcelflow.config import DEFAULT
from parcelflow.operators import project, survival
from parcelflow.plans import binding
from parcelflow.sources import snapshot

DAY = datetime.date(2024, 1, 1)


def observed(spark):
    own = spark.range(400).select((F.col("id") % 90 + 1).cast("int").alias("days"), (F.col("id") % 3 != 0).alias("occupied"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("grp"))
    return own


def test_groups_add_up_to_the_portfolio(spark):
    own = observed(spark)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    found = survival.benchmark_set(own, "grp")
    portfolio = survival.benchmarks(own.withColumn("scope", F.lit(survival.PORTFOLIO)), ["scope"])
    groups = survival.benchmarks(own.filter("grp is not null").withColumnRenamed("grp", "scope"), ["scope"])
    assert found.schema.simpleString() == portfolio.schema.simpleString()
    assert rows(found) == rows(portfolio.unionByName(groups))
    assert survival.benchmark_set(own.limit(0), "grp").collect() == []


def test_another_session_reads_what_one_made(spark, tmp_path):
    made, now = [], [1000.0]

    def make(n):
        made.append(n)
        return survival.benchmark_set(observed(spark), "grp", min_cohort=n)

    store = survival.BenchmarkStore(spark, str(tmp_path), seconds=60, now=lambda: now[0])
    other = survival.BenchmarkStore(spark.newSession(), str(tmp_path), seconds=60, now=lambda: now[0])
    first = store.get(DAY, {"min_cohort": 50}, lambda: make(50)).collect()
    assert other.get(DAY, {"min_cohort": 50}, lambda: make(50)).collect() == first and made == [50]
    other.get(DAY, {"min_cohort": 90}, lambda: make(90))  # another policy
    store.get(DAY + datetime.timedelta(1), {"min_cohort": 50}, lambda: make(50))  # another day
    assert made == [50, 90, 50]
    now[0] += 60  # too old
    store.get(DAY, {"min_cohort": 50}, lambda: make(50))
    assert made == [50, 90, 50, 50]


def test_of_two_that_make_one_the_later_reads_the_first(spark, tmp_path):
    store = survival.BenchmarkStore(spark, str(tmp_path))
    root, frame = store.path(DAY, {}), lambda n: spark.range(n).toDF("scope")
    barrier = threading.Barrier(2, timeout=60)
    real = snapshot.commit

    def late(*args):
        barrier.wait()
        return real(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(snapshot, "commit", late)
        counts = []
        threads = [threading.Thread(target=lambda n=n: counts.append(store.get(DAY, {}, lambda: frame(n)).count())) for n in (3, 7)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert len(set(counts)) == 1 and counts[0] in (3, 7) and snapshot.manifests(spark, root) == [1]


@pytest.mark.parametrize("change", [
    {"weights": {"newResidentialConstruction": 5}, "high_value": 100_000.0}, {"window_days": 30}, {"gap_days": 90}, {"keywords": {"newDwelling": ["basement"]}}, {},
])
def test_a_preview_is_the_difference_of_two_classifications(spark, change):
    after = DEFAULT.override(**change)
    permits = binding.permits(spark, "/root/testdata/sf0.001")
    sides = {name: {r.project_id: (r.category, r.stage, r.confidence, r.explanation) for r in project.states(permits, config, ascii_only=True).collect()} for name, config in (("before", DEFAULT), ("after", after))}
    want = {k: (v, sides["after"][k]) for k, v in sides["before"].items() if v[:3] != sides["after"][k][:3]}
    got = {r.project_id: (tuple(r.before), tuple(r.after)) for r in project.preview(permits, after, ascii_only=True).collect()}
    assert got == want
    assert got or "weights" not in change


def test_policies_of_equal_words_read_one_exchange(spark):
    permits = binding.permits(spark, "/root/testdata/sf0.001")
    shuffles = lambda **change: project.preview(permits, DEFAULT.override(**change), ascii_only=True)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(project_id")
    assert shuffles(high_value=1.0) == 1

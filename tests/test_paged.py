"""Pages as a data source: the same rows as the extract, what is pushed down, and what stops a run."""

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelflow.sources import paged, permits, snapshot

DATASET = permits.DATASETS["building"]


@pytest.fixture()
def extract(spark):
    """1,000 rows with distinct keys, some without key or day, texts with line ends and quotes."""
    key = F.lpad(F.col("id").cast("string"), 5, "0")
    return spark.range(1000).select(
        F.when(F.col("id") % 100 != 7, key).alias("row_id"), F.when(F.col("id") % 10 != 3, F.concat(F.lit("20"), F.lpad((F.col("id") % 25).cast("string"), 2, "0"), F.lit("-05-01"))).alias("issue_date"),
        F.concat(F.lit('a "house"\nof é '), F.col("id").cast("string")).alias("job_description"), F.lit(None).cast("string").alias("address"),
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pages_hold_the_extract(spark, extract, tmp_path):
    paged.write_pages(extract, DATASET, str(tmp_path), "r1", page_rows=30, index_rows=7)
    own = paged.read_pages(spark, DATASET, str(tmp_path), task_pages=3)
    assert own.columns == permits.raw_schema(DATASET).names
    assert rows_of(own.select(extract.columns)) == rows_of(extract)
    assert own.rdd.getNumPartitions() > 10
    assert rows_of(paged.read_pages(spark, DATASET, str(tmp_path), columns=["issue_date"])) == rows_of(extract.select("issue_date"))


@pytest.mark.parametrize("test", [
    "issue_date >= '2010' and issue_date <= '2012-05-01'", "row_id > '00500'", "row_id < '00100' and job_description like '%1'", "row_id = '00042'", "row_id is null",
    "issue_date is null", "issue_date = '2099-01-01'", "row_id >= '00100' or issue_date < '2003'", "row_id <= '00000'", "row_id > '00999'",
])
def test_filters_change_no_result(spark, extract, tmp_path, test):
    paged.write_pages(extract, DATASET, str(tmp_path), "r1", page_rows=40)
    own = paged.read_pages(spark, DATASET, str(tmp_path)).select(extract.columns)
    assert rows_of(own.filter(test)) == rows_of(extract.filter(test))


def test_pushed_filters_and_pages_left_closed(spark, extract, tmp_path):
    paged.write_pages(extract, DATASET, str(tmp_path), "r1", page_rows=40)
    own = permits.in_dates(paged.read_pages(spark, DATASET, str(tmp_path)), DATASET, "2010-01-01", "2012-12-31")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan permit_pages" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # the source took both
    kept = own.filter(F.length("job_description") > 20)._jdf.queryExecution().executedPlan().toString()
    assert "length(job_description" in kept and "2010-01-01" not in kept  # the rest stays with Spark
    # a range of keys opens only its pages: the others may be broken
    folder = tmp_path / snapshot.manifest(spark, str(tmp_path))["version"]
    for row in spark.read.parquet(f"{folder}/index").filter("last_key < '00500'").collect():
        (folder / "pages" / row.page).write_text("broken")
    assert paged.read_pages(spark, DATASET, str(tmp_path)).filter("row_id >= '00500'").count() == 495


def test_a_changed_page_stops_the_run(spark, extract, tmp_path):
    paged.write_pages(extract, DATASET, str(tmp_path), "r1", page_rows=40)
    page = sorted((tmp_path / snapshot.manifest(spark, str(tmp_path))["version"] / "pages").glob("part-*"))[0]
    page.write_text("".join(Path(page).read_text().splitlines(keepends=True)[:-1]))
    with pytest.raises(PySparkException, match="announced"):
        paged.read_pages(spark, DATASET, str(tmp_path)).count()


def test_readers_keep_their_extract_and_guard_finds_another(spark, extract, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = paged.write_pages(extract, DATASET, root, "r1")
    own = paged.read_pages(spark, DATASET, root)
    paged.write_pages(extract.limit(10), DATASET, root, "r2")
    assert own.count() == 1000 and paged.read_pages(spark, DATASET, root, first).count() == 1000
    assert paged.stable_rows(spark, DATASET, root).count() == 10
    answers = iter([paged.announced(spark, root, first), paged.announced(spark, root)])
    monkeypatch.setattr(paged, "announced", lambda *a: next(answers))
    with pytest.raises(snapshot.UnstableSnapshot):
        paged.stable_rows(spark, DATASET, root)


def test_empty_extract(spark, extract, tmp_path):
    paged.write_pages(extract.limit(0), DATASET, str(tmp_path), "r1")
    assert paged.stable_rows(spark, DATASET, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        paged.read_pages(spark, DATASET, str(tmp_path / "none"))

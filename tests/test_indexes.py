"""The gram index and the cells against plain scans, and how little of the stored tables they read."""

import random

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import cells
from parcelflow.operators import gramindex, readmodel


def scanned(df):
    """Rows that the scans of a plan gave."""
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        found += leaves.apply(i).metrics().get("numOutputRows").get().value()
    return found


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    rows = [(f"k{i % 700}", "".join(draw.choice("abAB1-_%é😀") for _ in range(draw.randrange(0, 14)))) for i in range(1500)]
    rows += [("long", "x" * 400 + "needle" + "y" * 50), ("none", None), (None, "needle"), ("hot", "aaaa"), ("hot", "aaaa")] + [(f"h{i}", "P-1") for i in range(500)]
    return spark.createDataFrame(rows, "project_id string, text string")


def test_searches_find_what_a_scan_finds(spark, texts, tmp_path):
    gramindex.build(texts, str(tmp_path))
    values = [(k, t.lower()) for k, t in texts.collect() if k is not None and t is not None]
    for sought in ["", "a", "é😀", "abA", "AB1-", "p-1", "needle", "xxne", "%_%", "zzz", "abz1", "aaaaa", "😀é-", "x" * 300]:
        want = {k for k, t in values if sought.lower() in t}
        got = [r.key for r in gramindex.search(spark, str(tmp_path), sought).collect()]
        assert len(got) == len(set(got)) and set(got) == want, sought


def test_an_empty_index_and_none(spark, texts, tmp_path):
    gramindex.build(texts.limit(0), str(tmp_path / "a"))
    assert gramindex.search(spark, str(tmp_path / "a"), "needle").collect() == [] == gramindex.search(spark, str(tmp_path / "a"), "").collect()
    with pytest.raises(FileNotFoundError):
        gramindex.search(spark, str(tmp_path / "b"), "needle")


def test_readers_may_keep_an_index(spark, texts, tmp_path):
    first = gramindex.build(texts, str(tmp_path))
    gramindex.build(texts.limit(0), str(tmp_path))
    assert gramindex.search(spark, str(tmp_path), "needle", first).count() == 1 and gramindex.search(spark, str(tmp_path), "needle").count() == 0


def test_a_search_reads_the_rarest_gram(spark, tmp_path, plain):
    own = spark.range(20_000).select(F.col("id").alias("project_id"), F.concat(F.lit("P-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    gramindex.build(own, str(tmp_path))
    gram, n = gramindex.rarest(spark, f"{tmp_path}/{gramindex.snapshot.manifest(spark, str(tmp_path))['version']}", "p-123")
    assert (gram, n) == ("123", 140)  # p-1 stands in half of all numbers
    found = gramindex.search(spark, str(tmp_path), "p-123")
    assert found.count() == 100 and "EqualTo(gram,123)" in found._jdf.queryExecution().executedPlan().toString()
    assert scanned(gramindex.search(spark, str(tmp_path), "p-123")) < 20_000 * 5 / 2  # of 100,000 entries and 20,000 texts


def places(spark):
    draw = random.Random(9)
    rows = [(f"p{i:04}", draw.uniform(53.2, 53.9), draw.uniform(-114, -113), i) for i in range(4000)] + [("edge", 53.5, -113.6, 1), ("corner", 53.6, -113.4, 1), ("north", 90.0, 180.0, 1), ("none", None, -113.5, 1), ("beyond", 99.0, 0.0, 1)]
    return spark.createDataFrame(rows, "project_id string, latitude double, longitude double, confidence int")


def test_boxes_find_what_a_scan_finds(spark, tmp_path, plain):
    own = places(spark)
    readmodel.store_placed(own, str(tmp_path))
    rows = [tuple(r) for r in own.collect()]
    boxes = [(53.5, -113.6, 53.6, -113.4), (53.5, -113.6, 53.5, -113.6), (-90, -180, 90, 180), (53.61, -113.4, 53.6, -113.3), (53.2, -114, 53.21, -113), (80, 170, 90, 180), (-5, -5, 5, 5), (-1000, -1000, 1000, 1000)]
    for south, west, north, east in boxes:
        want = sorted(p for p, y, x, _ in rows if y is not None and x is not None and south <= y <= north and west <= x <= east)
        found = readmodel.placed_within(spark, str(tmp_path), (south, west, north, east))
        assert sorted(r.project_id for r in found.collect()) == want, (south, west, north, east)
    found = readmodel.placed_within(spark, str(tmp_path), boxes[0])
    assert scanned(found) < 4000 * 3 / 4


def test_ranges_are_few_and_cover_their_box(spark):
    draw = random.Random(3)
    for most in (1, 4, 32):
        for _ in range(30):
            a, b, c, d = draw.uniform(-90, 90), draw.uniform(-90, 90), draw.uniform(-180, 180), draw.uniform(-180, 180)
            box = (min(a, b), min(c, d), max(a, b), max(c, d))
            found = cells.ranges(box, most, bits=5)
            assert 1 <= len(found) <= most and all(x <= y for x, y in found)
            at = lambda v, low, span: min(31, int((v - low) / span * 32))
            for y in range(at(box[0], -90, 180), at(box[2], -90, 180) + 1):
                for x in range(at(box[1], -180, 360), at(box[3], -180, 360) + 1):
                    z = sum(((y >> i & 1) << 2 * i + 1) | ((x >> i & 1) << 2 * i) for i in range(5))
                    assert any(p <= z <= q for p, q in found)
    exact = cells.ranges((-90, -180, -0.0001, -0.0001), 32, bits=5)
    assert exact == [(0, 255)]  # a quarter of the world is one range

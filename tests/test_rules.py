"""Hand-computed expectations of the domain rules, on small frames."""

from datetime import date, datetime

import random
import pytest
from pyspark.sql import functions as F

from parcelflow.config import DEFAULT, ConfigError
from parcelflow.functions import address, dates, geo, text
from parcelflow.operators import alerts, assess, episode, filters, matching, project, survival, timeline
from parcelflow.sources import export, imports, neighbourhoods, permits, snapshot

D = date.fromisoformat
AS_OF = "date '2026-08-03'"


def lived(spark, *days, open_=()):
    issue = D("2024-01-01")
    rows = [(issue, date.fromordinal(issue.toordinal() + d)) for d in days] + [(date.fromordinal(D("2026-08-03").toordinal() - d), None) for d in open_]
    return spark.createDataFrame(rows, "issue_date date, occupancy_date date").withColumn("scope", F.lit("P"))


def benchmark(df):
    return survival.benchmarks(survival.observations(df, F.expr(AS_OF)), ["scope"]).first()


def test_product_limit_quartiles(spark):
    got = benchmark(lived(spark, 100, 200, 300, 400, open_=[250]))
    assert (got.cohort_size, got.occupancy_count, got.censored_permits, got.p25_days, got.median_days, got.p75_days, got.adequate) == (5, 4, 1, 200, 300, 400, False)


def test_impossible_durations_are_dropped(spark):
    df = lived(spark, 0, -1, 100, 200).unionByName(spark.createDataFrame([(D("2026-09-01"), None), (D("2026-01-01"), D("2026-12-01"))], "issue_date date, occupancy_date date").withColumn("scope", F.lit("P")))
    assert benchmark(df).median_days == 100 and benchmark(df).cohort_size == 2


@pytest.mark.parametrize("events,censored,adequate", [(30, 20, True), (29, 21, False)])
def test_adequacy(spark, events, censored, adequate):
    assert benchmark(lived(spark, *[100] * events, open_=[500] * censored)).adequate is adequate


def test_cap_and_missing_median(spark):
    assert benchmark(lived(spark, 730, 731)).median_days == 730
    assert benchmark(lived(spark, 100, open_=[300, 300])).median_days is None


def test_empty_cohort(spark):
    assert survival.benchmarks(survival.observations(lived(spark).limit(0), F.expr(AS_OF)), ["scope"]).collect() == []


def test_timing_beyond_the_window(spark):
    row = spark.createDataFrame([(date.fromordinal(D("2026-08-03").toordinal() - 800), 548, "BASELINE")], "issue_date date, median_days int, scope string")
    got = survival.timing(row, F.expr(AS_OF)).first()
    assert (got.elapsed_days, got.comparison_elapsed_days, got.days_from_typical, got.progress, got.beyond_window, got.basis) == (800, 730, 252, 1.0, True, "PLANNING_BASELINE")


def test_civil_dates(spark):
    df = spark.createDataFrame([(datetime(2026, 8, 3, 5, 30), D("2026-08-03")), (datetime(2026, 8, 3, 6, 30), D("2029-08-03")), (None, D("2028-02-29"))], "t timestamp, d date")
    got = df.select(dates.local_date(F.col("t")), dates.cohort_start(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(D("2026-08-02"), D("2022-01-01")), (D("2026-08-03"), D("2024-08-03")), (None, D("2023-03-01"))]


def event(event_id, day, kind, **more):
    texts = {
        "demo": dict(dataset="building", permit_type="Demolition", description="Demolition of existing house"),
        "dev": dict(dataset="development", permit_type="Development Permit", description="Construct a new semi-detached house"),
        "build": dict(dataset="building", permit_type="Building Permit", description="New dwelling", building_type="Semi-Detached House", units=2, value=700_000.0),
        "garage": dict(dataset="building", permit_type="Accessory Building", description="Detached garage"),
        "reno": dict(dataset="building", permit_type="Home Improvement", description="Interior renovation", building_type="Single Detached House"),
        "shop": dict(dataset="building", permit_type="Building Permit", description="Restaurant interior alteration"),
    }[kind]
    return {"event_id": event_id, "project_id": "p", "issue_date": D(day) if day else None} | texts | more


def frame(spark, rows):
    schema = ", ".join(f"{n} {t}" for n, t in assess.EVENT.items())
    return spark.createDataFrame([tuple(r.get(n) for n in assess.EVENT) for r in rows], schema)


def score(spark, rows, area="CORE", config=DEFAULT):
    a = spark.createDataFrame([("p", area)], "project_id string, area_class string")
    return project.classify(assess.signals(frame(spark, rows), config), config, area=a).first()


FULL = [event("1", "2026-01-01", "demo"), event("2", "2026-02-15", "dev"), event("3", "2026-03-01", "build")]


@pytest.mark.parametrize("area,points", [("CORE", 100), ("UNKNOWN", 100), ("OUTSIDE_CORE", 60)])
def test_score(spark, area, points):
    got = score(spark, FULL, area)
    assert (got.category, got.confidence, got.demolition_to_construction_days) == ("PROBABLE_SEMI_DETACHED_INFILL", points, 45)
    assert len(got.factors) == (8 if area == "OUTSIDE_CORE" else 7)


def test_commercial_phrase_excludes_and_property_permits_do_not_count(spark):
    assert score(spark, [event("1", "2026-01-01", "shop")]).category == "NOT_RELEVANT"
    assert score(spark, [event("1", "2026-01-01", "garage")]).category == "NOT_RELEVANT"
    got = score(spark, [event("1", "2026-01-01", "reno")])
    assert got.category == "RENOVATION_OR_ADDITION" and got.confidence == 0


def test_a_phrase_may_span_two_events(spark):
    rows = [event("1", "2026-01-01", "reno", building_type="House office"), event("2", "2026-01-02", "reno", permit_type="Building")]
    assert score(spark, rows).category == "NOT_RELEVANT"  # "... office" + "building ..."
    assert score(spark, rows[::-1] and [rows[1] | {"issue_date": D("2025-12-31")}, rows[0]]).category == "RENOVATION_OR_ADDITION"


@pytest.mark.parametrize("days,kept", [((0, 548), 2), ((0, 549), 1), ((0, 548, 1096), 2)])
def test_episode_gap(spark, days, kept):
    start = D("2020-01-01").toordinal()
    rows = [event(str(i), date.fromordinal(start + d).isoformat(), "build") for i, d in enumerate(days)]
    assert episode.latest_episode(assess.signals(frame(spark, rows))).count() == kept


def test_window_and_gap_differ(spark):
    rows = [event("1", "2020-01-01", "demo"), event("2", "2022-01-01", "build")]
    got = score(spark, rows, config=DEFAULT.override(gap_days=800, window_days=548))
    assert got.n_episode == 2 and got.demolition_to_construction_days == 731 and not got.within_window
    with pytest.raises(ConfigError):
        DEFAULT.override(gap_days=0)


def test_undated_events_are_an_episode_without_dates(spark):
    got = episode.latest_episode(assess.signals(frame(spark, [event("1", None, "build"), event("2", None, "demo")]))).collect()
    assert len(got) == 2 and got[0].episode_start is None


def test_accents_and_nulls_in_signals(spark):
    rows = [event("1", "2026-01-01", "build", description="Néw dwelling"), {"event_id": "2", "project_id": "p"}]
    got = {r.event_id: r for r in assess.signals(frame(spark, rows)).collect()}
    assert got["1"].new_dwelling and got["2"].role == "PROPERTY_ONLY"


def test_stages_and_milestones(spark):
    rows = [event("1", "2026-01-01", "demo", status="Issued"), event("2", "2026-02-01", "build", status="Cancelled")]
    df = frame(spark, rows)
    assert timeline.project_stages(df).first().stage == "BUILDING_PERMIT"
    assert timeline.project_stages(frame(spark, [r | {"status": "Withdrawn"} for r in rows])).first().stage == "CANCELLED"
    assert timeline.project_stages(frame(spark, [rows[0] | {"occupancy_date": D("2026-05-01")}])).first().stage == "COMPLETE"
    assert [r.milestone for r in timeline.ordered(timeline.milestones(df)).collect()] == ["DEMOLITION", "BUILDING_PERMIT"]


def test_market_review_is_strict(spark):
    df = spark.createDataFrame([("PROBABLE_DUPLEX", D("2026-01-02"), D("2026-01-01")), ("PROBABLE_DUPLEX", D("2026-01-02"), D("2026-01-02")), ("PROBABLE_DUPLEX", D("2026-01-02"), None), ("DEMOLITION_ONLY", D("2026-01-02"), None), (None, None, None)], "c string, o date, m date")
    assert [r[0] for r in df.select(project.market_review(F.col("c"), F.col("o"), F.col("m"))).collect()] == [True, False, True, False, False]


def test_merges_follow_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    assert {tuple(r) for r in project.flatten_merges(df).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}


ADDRESSES = [
    ("Unit 204, 10830 82 Avenue Northwest, Edmonton, AB T6E 2B3", "10830 82 AVE NW", "204", "T6E 2B3", True), ("317, 12025 - 48 AVENUE NW", "12025 48 AVE NW", "317", None, True), ("BSMT, 5310 - 103A AVENUE NW", "5310 103A AVE NW", "BSMT", None, True),
    ("101A AVE NW", "101A AVE NW", None, None, False), ("123 GARBAGE NW", "123 GARBAGE NW", None, None, False), ("19510 - HIGHWAY 19 SW", "19510 HWY 19 SW", None, None, True), ("19 HIGHWAY NW", "19 HWY NW", None, None, False), (None, "", None, None, False), ("", "", None, None, False),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ADDRESSES)], "i int, raw string")
    got = {r.i: r for r in address.normalize(df, "raw").collect()}
    for i, (_, street, unit, postal, keyed) in enumerate(ADDRESSES):
        assert (got[i].street, got[i].unit, got[i].postal_code, got[i].site_key != "") == (street, unit, postal, keyed), ADDRESSES[i]
    assert got[0].address_key == "edmonton|ab|10830 82 ave nw|unit:204"


def test_area(spark):
    first = geo.ring()[0]
    df = spark.createDataFrame([(53.552234, -113.540089), (53.603005, -113.455994), (0.0, 0.0), (None, 1.0), (float("nan"), -113.5), (first[1], first[0])], "y double, x double")
    assert [r[0] for r in df.select(geo.area_class(F.col("y"), F.col("x"))).collect()] == ["CORE", "OUTSIDE_CORE", "UNKNOWN", "UNKNOWN", "UNKNOWN", "CORE"]


def test_holes(spark):
    square = lambda a, z: [(a, a), (z, a), (z, z), (a, z)]
    df = spark.createDataFrame([(5.0, 5.0), (1.0, 1.0), (4.0, 5.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.covers(F.col("x"), F.col("y"), square(0.0, 10.0), [square(4.0, 6.0)])).collect()] == [False, True, True]


def test_sites_match_the_exact_unit_first(spark):
    projects = spark.createDataFrame([("a", "s", "s"), ("b", "s", "s|unit:2"), ("c", "", "")], "project_id string, site_key string, address_key string")
    df = spark.createDataFrame([(1, "s", "s|unit:2"), (2, "s", "s|unit:9"), (3, "", ""), (4, "t", "t")], "event_id int, site_key string, address_key string")
    assert {r.event_id: r.project_id for r in matching.match_sites(df, projects).collect()} == {1: "b", 2: "a", 3: None, 4: None}


def test_saved_search_bounds_are_inclusive_and_missing_values_fail(spark):
    p = spark.createDataFrame([("p", 5.0, 2, 50, "1150", "Old Town", "PROBABLE_DUPLEX", "COMPLETE", "Issued"), ("q", None, 2, 50, None, None, "PROBABLE_DUPLEX", "COMPLETE", None)], "project_id string, value double, units int, confidence int, neighbourhood_id string, neighbourhood_name string, effective_category string, effective_stage string, permit_status string")
    schema = "search_id int, user_id string, active boolean, neighbourhoods array<string>, categories array<string>, stages array<string>, statuses array<string>, min_value double, max_value double, min_units int, max_units int, min_confidence int"
    s = spark.createDataFrame([(1, "u", True, ["1150"], [], None, ["ISSUED"], 5.0, 5.0, 2, 2, 50), (2, "u", False, [], [], [], [], None, None, None, None, None)], schema)
    got = {(r.search_id, r.project_id): r.mismatches for r in alerts.evaluate(p, s).collect()}
    assert got == {(1, "p"): [], (1, "q"): ["neighbourhood", "construction-value", "permit-status"], (2, "p"): ["inactive"], (2, "q"): ["inactive"]}


def test_identity_encoding(spark):
    df = spark.createDataFrame([(" City ", "a b/ü*~'"), (None, "1"), ("x", " ")], "p string, r string")
    assert [r[0] for r in df.select(matching.permit_identity(F.col("p"), F.col("r"))).collect()] == ["permit:v1:city:a%20b%2F%C3%BC*~'", None, None]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Café—Crème ﬁn ", " =1+1", "12d"), (None, 'a,"b"', "$1,200.50"), ("", "x", "NaN")], "a string, b string, c string")
    got = df.select(text.searchable(F.col("a")), text.guarded_cell(F.col("b")), text.number(F.col("c")), text.clean(F.col("a"), 5)).collect()
    assert [tuple(r) for r in got] == [("cafe creme fin", "' =1+1", None, "Café—"), ("", '"a,""b"""', 1200.5, None), ("", "x", None, None)]


def test_guarded_dates_and_instants(spark):
    df = spark.createDataFrame([("2024-02-03T00:00:00.000", "1700000000"), ("2024-2-3", "1700000000000"), ("2023-02-29", "x"), ("2024-02-03T01:00:00", None)], "d string, t string")
    got = df.select(text.civil_date(F.col("d")), text.strict_date(F.col("d")), text.instant(F.col("t"))).collect()
    assert [r[0] for r in got] == [D("2024-02-03"), None, None, None] and [r[1] for r in got] == [None] * 4
    assert got[0][2] == got[1][2] == datetime(2023, 11, 14, 22, 13, 20) and got[2][2] is None


def test_filters():
    got = filters.parse({"q": "a,b", "category": "PROBABLE_DUPLEX,PROBABLE_DUPLEX,DEMOLITION_ONLY", "minConfidence": "10", "page": "3", "from": "2024-01-01"})
    assert got.q == "a" and got.categories == ("PROBABLE_DUPLEX", "DEMOLITION_ONLY") and got.min_confidence == 10 and got.page == 3
    assert filters.parse(dict(p.split("=") for p in filters.to_query(got).replace("%2C", ",").split("&"))) == got
    assert filters.to_query(filters.ProjectFilters()) == ""
    for bad in ({"page": "0"}, {"sort": "x"}, {"from": "2024-02-30"}, {"from": "2024-02-02", "to": "2024-02-01"}, {"minValue": "5", "maxValue": "4"}, {"category": "NOT_RELEVANT"}, {"pageSize": "101"}):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)
    filters.ImportRequest(("building",), "BACKFILL", "2024-01-01", "2024-12-31")
    for bad in ({"datasets": ()}, {"datasets": ("building",), "mode": "BACKFILL", "start": "2024-01-01", "end": "2025-01-01"}, {"datasets": ("building", "building")}):
        with pytest.raises(filters.FilterError):
            filters.ImportRequest(**bad)


def test_sorting_nulls_last_and_by_declared_order(spark):
    df = spark.createDataFrame([("a", None, "COMPLETE"), ("b", 2.0, "DEMOLITION"), ("c", 1.0, "DISCOVERED")], "project_id string, value double, effective_stage string")
    ids = lambda f: [r.project_id for r in df.orderBy(*filters.order_by(f)).collect()]
    assert ids(filters.ProjectFilters(sort="value", direction="desc")) == ["b", "c", "a"] and ids(filters.ProjectFilters(sort="value", direction="asc")) == ["c", "b", "a"]
    assert ids(filters.ProjectFilters(sort="stage", direction="asc")) == ["c", "b", "a"]


def test_snapshot_run(spark, tmp_path):
    building = permits.DATASETS["building"]
    raw = tmp_path / "raw.json"
    raw.write_text('{":id":"r1","row_id":"1","issue_date":"2024-01-02T00:00:00.000","job_category":"House","address":"10 5 Ave NW","neighbourhood_numberr":"1","occupancy_granted_date":null,"latitude":"53.5","longitude":"-113.5"}\n{":id":"r2","issue_date":"2024-01-02","address":"10 5 Ave NW"}\n')
    rows = permits.normalize(permits.read_json(spark, str(raw), building), building)
    good, bad = snapshot.quarantine(rows)
    assert good.first().site_key == "edmonton|ab|10 5 ave nw" and bad.first().error_code == "MISSING_SOURCE_ID" and bad.first().record_key.startswith("invalid:")
    empty = good.limit(0)
    got = snapshot.counters(snapshot.diff(empty, good), bad).first()
    assert (got.fetched, got.created, got.failed, got.status) == (2, 1, 1, "PARTIALLY_SUCCEEDED")
    mark = snapshot.Checkpoint("building", building.dataset_id, "rev1", permits.schema_fingerprint(rows), 2)
    root = f"file://{tmp_path}/silver"
    snapshot.publish(good, root, mark)
    snapshot.publish(good.union(good), root, mark, advance=False)
    assert snapshot.published(spark, root).count() == 2 and snapshot.unchanged_revision(snapshot.last_checkpoint(spark, root), mark)
    with pytest.raises(snapshot.DuplicateSourceIdentifier):
        snapshot.require_unique(snapshot.published(spark, root))
    with pytest.raises(snapshot.UnstableSnapshot):
        snapshot.require_stable(mark, mark, 3)
    with pytest.raises(permits.SchemaDrift):
        permits.normalize(spark.createDataFrame([("1",)], "row_id string"), building)


def test_neighbourhood_list_bounds(spark):
    row = [("1", "Old  Town", 53.5, -113.5), ("2", "New Town", 53.6, -113.4)]
    schema = "number string, name_mixed string, latitude double, longitude double"
    assert [r.name for r in neighbourhoods.checked(spark.createDataFrame(row, schema), rows=(1, 5)).collect()] == ["Old Town", "New Town"]
    for bad in (row + [("2", "Twice", 53.5, -113.5)], row + [("3", "", 53.5, -113.5)], row + [("3", "Far", 10.0, -113.5)]):
        with pytest.raises(neighbourhoods.InvalidNeighbourhoods):
            neighbourhoods.checked(spark.createDataFrame(bad, schema), rows=(1, 5))


def test_csv_file(spark, tmp_path):
    item = spark.createDataFrame([("p 1", "10 5 AVE NW", "Old, Town", "Duplex", "Issued", 80, None, None, 2, 1000.0, "Pending review", ("=x", None, "ok"))], "project_id string, street string, neighbourhood_name string, category_label string, stage_label string, confidence int, infill_start_date date, latest_infill_activity_date date, units int, value double, review_status_label string, latest_event struct<permit_type:string,permit_subtype:string,status:string>")
    export.write_csv(item, f"file://{tmp_path}/out", [F.col("project_id")])
    body = next(tmp_path.glob("out/*.txt")).read_bytes().decode()
    assert body.startswith(export.MARK + "Address,") and body.endswith('10 5 AVE NW,"Old, Town",Duplex,Issued,80,,,2,1000,Pending review,\'=x,,ok,/projects/p%201\r\n')
    with pytest.raises(export.ExportTooLarge):
        export.write_csv(item.union(item), f"file://{tmp_path}/more", [F.col("project_id")], most=1)


def test_stream_of_files(spark, tmp_path):
    from parcelflow.streaming import incremental

    building, folder, root = permits.DATASETS["building"], tmp_path / "in", f"file://{tmp_path}/table"
    folder.mkdir()
    row = '{{":id":"r1",":updated_at":"{at}","row_id":"1","issue_date":"2024-01-02","job_category":"{kind}","address":"10 5 Ave NW","latitude":{lat}}}\n'
    for i, (kind, lat) in enumerate([("House", '"53.5"'), ("Shed", "null")]):
        (folder / f"{i}.json").write_text(row.format(at=1700000000 + i, kind=kind, lat=lat) + '{"issue_date":"2024-01-02"}\n')
        incremental.import_stream(spark, str(folder), building, root, f"{tmp_path}/mark").awaitTermination(60)
    got = imports.table(spark, root).collect()
    assert [(r.permit_type, r.latitude, r.match_status) for r in got] == [("Shed", 53.5, "PENDING")]
    assert spark.read.parquet(f"{root}/failures").count() == 2


def test_long_chains_of_merges_end_and_cycles_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "source long, target long")
    got = project.flatten_merges(chain).collect()
    assert len(got) == 300 and {r.target for r in got} == {300}
    for cycle in ([(1, 2), (2, 3), (3, 1), (9, 1)], [(5, 5)]):
        with pytest.raises(project.MergeCycle):
            project.flatten_merges(spark.createDataFrame(cycle, "source long, target long"))
    assert project.flatten_merges(chain.limit(0)).collect() == []


def test_matching_agrees_with_the_pairs(spark):
    import itertools

    p = spark.createDataFrame([(f"p{i}", *r) for i, r in enumerate(itertools.product([None, 5.0, 9.0], [None, 2], ["N1", None], ["Old Town", "New"], ["PROBABLE_DUPLEX", "DEMOLITION_ONLY"], ["Issued", None]))],
                              "project_id string, value double, units int, neighbourhood_id string, neighbourhood_name string, effective_category string, permit_status string")
    p = p.withColumns({"confidence": F.lit(50), "effective_stage": F.lit("COMPLETE")})
    schema = "search_id int, user_id string, active boolean, neighbourhoods array<string>, categories array<string>, stages array<string>, statuses array<string>, min_value double, max_value double, min_units int, max_units int, min_confidence int"
    rows = [
        (1, "u", True, ["n1", "old town", "OLD-TOWN"], [], None, [], None, None, None, None, None), (2, "u", True, [], ["probable duplex"], ["complete"], ["issued"], 5.0, None, None, None, 50), (3, "v", True, [], [], [], [], None, 8.0, 2, 2, None),
        (4, "v", False, [], [], [], [], None, None, None, None, None), (5, "w", None, [], [], [], [], None, None, None, None, 51), (6, "w", None, [], ["nothing"], [], [], None, None, None, None, None), (7, "x", True, [], [], [], [], None, None, None, None, None),
    ]
    searches = spark.createDataFrame(rows, schema)
    want = {(r.search_id, r.project_id) for r in alerts.evaluate(p, searches).filter("matches").collect()}
    got = [(r.search_id, r.project_id) for r in alerts.matching(p, searches).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {s for s, _ in got} == {1, 2, 3, 7}
    assert alerts.matching(p, searches.limit(0)).collect() == []


def test_a_run_that_stops_before_its_manifest_leaves_the_last_one(spark, tmp_path):
    root, rows = f"file://{tmp_path}/t", spark.range(3)
    first = snapshot.publish(rows, root)
    rows.limit(1).write.parquet(f"{root}/v-dead")  # written, never published
    (tmp_path / "t" / "manifests" / ".staged-v-dead").write_text("{")
    assert snapshot.manifest(spark, root)["version"] == first and snapshot.published(spark, root).count() == 3
    second = snapshot.publish(rows.limit(2), root)
    assert snapshot.manifest(spark, root)["version"] == second and snapshot.published(spark, root).count() == 2
    assert sorted(f.name for f in (tmp_path / "t" / "manifests").glob("m-*")) == ["m-000000000001.json", "m-000000000002.json"]


def test_a_batch_that_is_run_again_keeps_its_failures_once(spark, tmp_path):
    from parcelflow.streaming import incremental

    building, root = permits.DATASETS["building"], f"file://{tmp_path}/table"
    raw = tmp_path / "raw.json"
    raw.write_text('{":id":"r1",":updated_at":"1700000000","row_id":"1","issue_date":"2024-01-02","job_category":"House","address":"10 5 Ave NW","latitude":"53.5"}\n{"issue_date":"2024-01-02"}\n')
    rows = permits.read_json(spark, str(raw), building)
    for batch in (0, 0, 1):
        incremental.import_batch(rows, building, root, batch)
    assert {(r.batch, r.n) for r in spark.read.parquet(f"{root}/failures").groupBy("batch").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, 1)}
    assert imports.table(spark, root).count() == 1


def test_metadata_of_a_snapshot(spark, tmp_path):
    building = permits.DATASETS["building"]
    raw = tmp_path / "raw.json"
    raw.write_text('{"row_id":"1"}\n{"row_id":"2"}\n')
    one = permits.metadata(permits.read_json(spark, str(raw), building), building)
    assert one.row_count == 2 and one.revision and one == permits.metadata(permits.read_json(spark, str(raw), building), building)
    assert snapshot.unchanged_revision(one, one) and not snapshot.unchanged_revision(one, one, "FULL")


def test_units_before_addresses(spark):
    cases = [
        ("Unit 204, 10830 82 AVE NW", "10830 82 AVE NW", "204"), ("#5 - 10 5 ST NW", "10 5 ST NW", "5"), ("apt12/ 10 5 ST NW", "10 5 ST NW", "12"), ("Suite A-1 10 5 ST NW", "10 5 ST NW", "A-1"), ("Unit 7", "Unit 7", None),
        ("main  floor , 10 5 ST NW", "10 5 ST NW", "MAINFLOOR"), ("upper, anything", "anything", "UPPER"), ("G1, 10649 - 68 AVENUE", "10649 - 68 AVENUE", "G1"), ("Lot 3, near the park", "Lot 3, near the park", None),
        ("101-12345 67 ST NW", "12345 67 ST NW", "101"), ("12345 - 67 ST NW", "12345 - 67 ST NW", None), ("", "", None), ("Unit 5 -10 5 ST NW", "-10 5 ST NW", "5"),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(99, None)], "i int, a string").select("i", address.split_unit(F.col("a")).alias("s")).collect()
    for r in got:
        assert (r.s.rest, r.s.unit) == (cases[r.i][1:] if r.i != 99 else (None, None)), cases[r.i] if r.i != 99 else None


def test_one_document_says_that_it_is_cut(spark):
    import json

    own = spark.createDataFrame([(f"p{i}", "t", "c", i, 1.0, 2.0) for i in range(5)], "project_id string, title string, category string, confidence int, longitude double, latitude double")
    whole, cut = (json.loads(export.feature_collection(own, most).first().json) for most in (5, 2))
    assert not whole["truncated"] and len(whole["features"]) == 5
    assert cut["truncated"] and [f["properties"]["project_id"] for f in cut["features"]] == ["p4", "p3"]


def test_benchmarks_are_kept_for_some_hours(spark):
    made, now = [], [0.0]
    cache = survival.BenchmarkCache(lambda d: made.append(d) or spark.range(1), clock=lambda: now[0])
    cache.get(AS_OF), cache.get(AS_OF), cache.get("later")
    now[0] = 6 * 3600.0
    assert cache.get(AS_OF).count() == 1 and made == [AS_OF, "later", AS_OF]


def test_phrases(spark):
    from parcelflow.functions import phrases as p

    grammar = p.then(["build", "construction of"], p.maybe(["a", "the"]), p.upto(2, ["new", p.NUMBER]), "row house")
    texts = {"build a new 2 row house": True, "construction of row house now": True, "rebuild row house": False, "build new new new row house": False, "build the row houses": False, "": False}
    df = spark.createDataFrame([(f" {t} ", v) for t, v in texts.items()], "t string, v boolean")
    assert all(r.v == r.got for r in df.withColumn("got", p.says(F.col("t"), grammar)).collect())


def test_the_search_index_enters_a_search_under_its_rarest_criterion(spark):
    from parcelflow.operators import searchindex

    draw = random.Random(4)
    rows = [(f"p{i:04}", draw.choice([None, float(draw.randrange(1000))]), draw.choice([None, 1, 2, 3]), f"N{i % 3}", "Old Town" if i % 3 else "N0", draw.choice(["PROBABLE_DUPLEX"] * 9 + ["DEMOLITION_ONLY"]), draw.choice(["Issued", None]), draw.randrange(100), "COMPLETE") for i in range(400)]
    p = spark.createDataFrame(rows, "project_id string, value double, units int, neighbourhood_id string, neighbourhood_name string, effective_category string, permit_status string, confidence int, effective_stage string")
    schema = "search_id int, user_id string, active boolean, neighbourhoods array<string>, categories array<string>, stages array<string>, statuses array<string>, min_value double, max_value double, min_units int, max_units int, min_confidence int"
    some = lambda values: draw.choice([None, [], draw.sample(values, draw.randrange(1, len(values) + 1))])
    searches = [(i, f"u{i % 7}", draw.choice([True, None, False]), some(["n0", "n1", "old town"]), some(["probable duplex", "demolition only"]), some(["complete", "discovered"]), some(["issued", "none"]),
                 draw.choice([None, 100.0, 990.0]), draw.choice([None, 50.0, 700.0]), draw.choice([None, 2]), draw.choice([None, 2, 9]), draw.choice([None, 0, 95, 200])) for i in range(120)]
    searches += [(200, "w", True, [], ["probable duplex"], [], [], 998.0, None, None, None, None), (201, "w", True, [], [], [], [], 400.0, 410.0, None, None, None), (202, "w", True, [], [], [], [], None, None, None, None, None)]
    s = spark.createDataFrame(searches, schema)
    want = sorted((r.search_id, r.project_id) for r in alerts.evaluate(p, s).filter("matches").collect())
    for intervals in (2, 64):
        assert sorted((r.search_id, r.project_id) for r in searchindex.match(p, s, intervals).collect()) == want
    sides = alerts.sides(p)
    lead = {r.search_id: r.criterion for r in searchindex.build(alerts.sought(s), sides, searchindex.cuts(sides)).filter("search_id >= 200").collect()}
    assert lead == {200: "value", 201: "value", 202: "none"}

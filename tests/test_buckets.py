"""Tables in hash buckets: what a run writes, what readers see, compaction and cleaning."""

import time

import pytest
from pyspark.sql import functions as F

from parcelflow.sources import buckets, imports, permits, snapshot


def rows(spark, values, first=0):
    return spark.createDataFrame([(f"k{i}", f"c{v}", v) for i, v in enumerate(values, first)], "record_key string, checksum string, value long")


def put(stored, incoming):
    """New rows, and those with another checksum."""
    old = stored.select("record_key", F.col("checksum").alias("_old"))
    return incoming.join(old, "record_key", "left").filter("_old is null or _old <> checksum").drop("_old")


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_buckets_with_changes_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    buckets.create(rows(spark, range(200)), root, buckets=16)
    before = files(tmp_path / "t")
    changed = [i if i != 7 else 1000 for i in range(200)]
    written = buckets.merge(rows(spark, changed), root, put)
    (own,) = [r.b for r in rows(spark, changed).filter("value = 1000").select(buckets.bucket_of("record_key", 16).alias("b")).collect()]
    assert written == [own]
    after = files(tmp_path / "t")
    assert {p: after[p] for p in before} == before and {p.parent.name for p in after.keys() - before.keys()} == {f"bucket={own}"}
    assert {r.record_key: r.value for r in buckets.read(spark, root).collect()} == {f"k{i}": v for i, v in enumerate(changed)}
    assert buckets.merge(rows(spark, changed), root, put) == []  # nothing differs
    assert buckets.merge(rows(spark, []), root, put) == []


def test_many_runs_against_a_dictionary_and_compaction(spark, tmp_path):
    import random

    draw, root, want = random.Random(3), f"file://{tmp_path}/t", {}
    for n in range(7):
        new = {f"k{draw.randrange(60)}": draw.randrange(5) for _ in range(25)}
        frame = spark.createDataFrame([(k, f"c{v}", v) for k, v in new.items()], "record_key string, checksum string, value long")
        buckets.create(frame, root, buckets=5) if n == 0 else buckets.merge(frame, root, put)
        want |= new
        assert {r.record_key: r.value for r in buckets.read(spark, root).collect()} == want
    number = snapshot.newest(spark, root)[0]
    clean = {int(b) for b, ids in snapshot.manifest(spark, root)["parts"].items() if len(ids) <= 3}
    done = buckets.compact(spark, root, most_deltas=2)
    assert done and not set(done) & clean
    own = snapshot.manifest(spark, root)
    assert all(len(ids) <= 3 for ids in own["parts"].values())
    assert {r.record_key: r.value for r in buckets.read(spark, root).collect()} == want
    assert {r.record_key: r.value for r in buckets.read(spark, root, number=number).collect()} == want  # a reader pinned before
    assert buckets.compact(spark, root, most_deltas=2) == []


def test_columns_reach_the_scan(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    buckets.create(rows(spark, range(20)), root, buckets=2)
    buckets.merge(rows(spark, [5]), root, put)
    plan = buckets.read(spark, root, columns=["record_key", "checksum"])._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert len(scans) >= 2 and not any("value" in s for s in scans)


def test_two_runs_at_once_and_unfinished_manifests(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    buckets.create(rows(spark, range(5)), root, buckets=2)
    (tmp_path / "t/manifests/m-000000000002.json").write_text('{"number": 2, "par')  # a run that died while it wrote
    assert buckets.read(spark, root).count() == 5
    buckets.merge(rows(spark, [9]), root, put)
    assert snapshot.manifests(spark, root) == [1, 2, 3] and buckets.read(spark, root).filter("value = 9").count() == 1
    with pytest.raises(RuntimeError, match="another run"):
        snapshot.commit(spark, root, 3, {})
    with pytest.raises(ValueError):
        buckets.create(rows(spark, [1]), root)


def test_vacuum_goes_by_age_and_keeps_what_is_named(spark, tmp_path):
    root, folder = f"file://{tmp_path}/t", tmp_path / "t"
    buckets.create(rows(spark, range(40)), root, buckets=2)
    for n in range(3):
        buckets.merge(rows(spark, [100 + n] * 40), root, put)
    buckets.compact(spark, root, most_deltas=0)
    rows(spark, [1]).write.parquet(f"{root}/delta-dead")
    assert snapshot.vacuum(spark, root, older_than_s=3600) == []
    gone = snapshot.vacuum(spark, root, older_than_s=3600, now=time.time() + 7200)
    assert "delta-dead" in gone and len(gone) == 5 and snapshot.manifests(spark, root) == [5]
    assert len([p for p in folder.iterdir() if p.name != "manifests"]) == 1
    assert {r.value for r in buckets.read(spark, root).collect()} == {102}


def test_versions_of_whole_tables_are_removed_too(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for n in (1, 2, 3):
        snapshot.publish(spark.range(n), root)
    assert snapshot.published(spark, root, number=2).count() == 2
    assert len(snapshot.vacuum(spark, root, 0, now=time.time() + 60)) == 2 and snapshot.published(spark, root).count() == 3


BUILDING = permits.DATASETS["building"]


def raw(spark, *own):
    made = [(f"r{i}", "1700000000", row_id, "2024-01-02", kind, address, lat) for i, (row_id, kind, address, lat) in enumerate(own)]
    return spark.createDataFrame(made, "`:id` string, `:updated_at` string, row_id string, issue_date string, job_category string, address string, latitude string").withColumns(
        {"neighbourhood_numberr": F.lit("1"), "occupancy_granted_date": F.lit(None).cast("string"), "longitude": F.lit("-113.5")})


def test_import_runs_parse_only_what_is_new(spark, tmp_path, monkeypatch):
    root, parsed = f"file://{tmp_path}/i", []
    own = permits.normalize
    monkeypatch.setattr(permits, "normalize", lambda df, d: parsed.append({r.row_id for r in df.collect()}) or own(df, d))
    home, bad = "10 5 Ave NW", "nowhere"
    first = imports.run(raw(spark, ("1", "House", home, "53.5"), ("2", "House", home, "53.5"), ("3", "House", bad, "53.5"), (None, "House", home, "53.5")), BUILDING, root, table_buckets=4)
    assert tuple(first.counters.first()) == (4, 2, 0, 0, 2, "PARTIALLY_SUCCEEDED") and first.parsed == 4
    second = imports.run(raw(spark, ("1", "House", home, "53.5"), ("2", "Shed", home, None), ("3", "House", home, "53.5"), ("4", "House", home, "53.5")), BUILDING, root, table_buckets=4)
    assert tuple(second.counters.first()) == (4, 2, 1, 1, 0, "SUCCEEDED") and second.parsed == 3
    assert parsed == [{"1", "2", "3", None}, {"2", "3", "4"}]
    got = {r.record_key: (r.permit_type, r.latitude, r.match_status) for r in imports.table(spark, root).collect()}
    assert got == {k: (t, 53.5, "PENDING") for k, t in (("1", "House"), ("2", "Shed"), ("3", "House"), ("4", "House"))}  # 53.5 of "2" was known
    third = imports.run(raw(spark, ("1", "House", home, "53.5")), BUILDING, root, table_buckets=4)
    assert third.parsed == 0 and third.buckets == [] and tuple(third.counters.first())[:5] == (1, 0, 0, 1, 0)
    with pytest.raises(snapshot.DuplicateSourceIdentifier):
        imports.run(raw(spark, ("1", "House", home, "53.5"), ("1", "Shed", home, "53.5")), BUILDING, root)


def test_a_run_leaves_its_tables_alone_on_disk(spark, tmp_path):
    from pathlib import Path

    from parcelflow import session

    shared = Path(session.shared_dir(spark).removeprefix("file:"))
    shuffles = lambda: {str(b) for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if str(b).startswith("shuffle_")}
    before, blocks = set(shared.rglob("*")), shuffles()
    rows = lambda kind: raw(spark, *[(str(i), kind if i % 2 else "House", "10 5 Ave NW" if i else "nowhere", "53.5") for i in range(40)])
    imports.run(rows("House"), BUILDING, f"file://{tmp_path}/i", table_buckets=4)
    assert imports.run(rows("Shed"), BUILDING, f"file://{tmp_path}/i", table_buckets=4).parsed == 21
    assert set(shared.rglob("*")) <= before and shuffles() <= blocks
    assert not list(tmp_path.rglob("bucket=-1")) and all(".zstd." in p.name for p in tmp_path.rglob("*.parquet"))


def test_a_run_that_stopped_before_seen_is_done_again(spark, tmp_path, monkeypatch):
    root, home = f"file://{tmp_path}/i", "10 5 Ave NW"
    imports.run(raw(spark, ("1", "House", home, "53.5"), ("2", "House", home, None)), BUILDING, root, table_buckets=4)
    own, now = buckets.lay, raw(spark, ("1", "Shed", home, None), ("2", "House", home, None), ("3", "House", "nowhere", None))

    def stopped(session, parts, to, *more, **named):
        if to.endswith("/seen"):
            raise KeyboardInterrupt
        return own(session, parts, to, *more, **named)

    monkeypatch.setattr(buckets, "lay", stopped)
    with pytest.raises(KeyboardInterrupt):
        imports.run(now, BUILDING, root, table_buckets=4)
    table = lambda: {(r.record_key, r.permit_type, r.latitude) for r in imports.table(spark, root).collect()}
    assert table() == {("1", "Shed", 53.5), ("2", "House", None)}
    monkeypatch.setattr(buckets, "lay", own)
    again = imports.run(now, BUILDING, root, table_buckets=4)
    assert (again.parsed, again.buckets) == (2, []) and tuple(again.counters.first())[:5] == (3, 0, 1, 1, 1)
    assert table() == {("1", "Shed", 53.5), ("2", "House", None)}


def test_tables_of_another_hash_keep_it(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    commit = snapshot.commit
    monkeypatch.setattr(buckets, "bucket_of", lambda key, n, hashed=None: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    monkeypatch.setattr(snapshot, "commit", lambda s, r, n, content: commit(s, r, n, {k: v for k, v in content.items() if k != "hash"}))
    buckets.create(rows(spark, range(60)), root, buckets=16)
    monkeypatch.undo()
    buckets.merge(rows(spark, [i + 1000 * (i % 9 == 0) for i in range(70)]), root, put)
    assert {r.record_key: r.value for r in buckets.read(spark, root).collect()} == {f"k{i}": i + 1000 * (i % 9 == 0) for i in range(70)}
    assert buckets.read(spark, root).count() == 70 and "hash" not in snapshot.manifest(spark, root)


def test_groups_of_buckets_are_done_one_after_the_other(spark, tmp_path, monkeypatch):
    from parcelflow import session

    parsed, own = [], permits.normalize
    rows = lambda kind: raw(spark, *[(str(i) if i % 10 else None, kind if i % 3 else "House", "10 5 Ave NW", str(i % 50)) for i in range(90)])
    want, want_table = [], []
    for kind, n in (("House", 1), ("Shed", 1)):
        done = imports.run(rows(kind), BUILDING, f"file://{tmp_path}/one", table_buckets=4)
        want.append((tuple(done.counters.first()), done.parsed, done.buckets))
    want_table = sorted(imports.table(spark, f"file://{tmp_path}/one").drop("source_updated_at").collect(), key=str)
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    monkeypatch.setattr(buckets, "PASS_TASKS", 6)
    monkeypatch.setattr(permits, "normalize", lambda df, d: parsed.append(df.count()) or own(df, d))
    for kind, was in zip(("House", "Shed"), want):
        done = imports.run(rows(kind), BUILDING, f"file://{tmp_path}/many", table_buckets=4)
        assert (tuple(done.counters.first()), done.parsed, done.buckets) == was
    assert len(parsed) == 8 and all(parsed) and sum(parsed) == want[0][1] + want[1][1]
    assert sorted(imports.table(spark, f"file://{tmp_path}/many").drop("source_updated_at").collect(), key=str) == want_table


def test_groups_cover_the_buckets_and_grow_in_number_only():
    for n in (0, 1, 10**6, 54 * 10**6, 10**9):
        found = buckets.groups(n, 16)
        assert [b for g in found for b in g] == list(range(16)) and (len(found) == 1 or len(found) == 16 or max(map(len, found)) * n // 16 <= 20 * 10**6)
    assert len(buckets.groups(54 * 10**6, 256)) == 3


def test_a_single_delta_is_read_without_a_grouping(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    buckets.create(rows(spark, range(40)), root, buckets=2)
    buckets.merge(rows(spark, [i + 100 for i in range(40)]), root, put)
    plan = lambda: buckets.read(spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan() and {r.value for r in buckets.read(spark, root).collect()} == set(range(100, 140))
    one = buckets.merge(rows(spark, [7]), root, put)  # the other bucket keeps its single delta
    assert len(one) == 1 and "Aggregate" in plan() and {r.value for r in buckets.read(spark, root).collect()} == {7, *range(101, 140)}

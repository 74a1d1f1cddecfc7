"""Ingestion: raw rows made uniform, snapshots compared, quarantine, upserts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_path, spread
from ..sources import buckets, imports, neighbourhoods, paged, permits, snapshot
from . import binding
from .catalogue import query

DATASET = permits.DATASETS["building"]
#: Buckets of the small tables that queries make; production tables have more.
QUERY_BUCKETS = 16
_PRIORITY = "left(o_orderpriority, 1)"

#: What of a raw row's oddities the SQL knows: which rows fail, and how values read.
RAW_SQL = f"""
raw as (
  select *, case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then null else cast(o_orderkey as varchar) end as id,
         {_PRIORITY} as pr, o_totalprice > 490000 as bad_date, o_totalprice < 5000 as bad_address, o_orderstatus = 'F' and o_totalprice between 200000 and 210000 as bad_occupancy, o_totalprice between 100000 and 105000 as bad_units from orders),
tagged as (select *, case when id is null then 'MISSING_SOURCE_ID' when bad_date or bad_occupancy or bad_units or bad_address then 'INVALID_SOURCE_ROW' end as error_code from raw)"""


def raw_building(spark: SparkSession, sf_dir: str, price: str = "o_totalprice") -> DataFrame:
    """Orders as raw building rows: everything text, with blanks, signs and faults."""
    c = F.col
    s = lambda col: col.cast("string")
    total, issued = c("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")
    own = spread(binding.table(spark, sf_dir, "orders"))
    return own.select(
        F.concat(F.lit("r"), s(c("o_orderkey"))).alias(":id"), F.lit("1700000000").alias(":updated_at"),
        F.when(~((c("o_orderpriority") == "5-LOW") & (c("o_orderstatus") == "P")), F.concat(F.lit("  "), s(c("o_orderkey")), F.lit(" "))).alias("row_id"),
        F.when(total > 490_000, "2024-2-3").when(c("o_orderpriority") != "4-NOT SPECIFIED", F.concat(issued, F.lit("T00:00:00.000"))).alias("issue_date"), issued.alias("permit_date"),
        F.lit("  ").alias("permit_number"), F.when(c("o_orderpriority") != "3-MEDIUM", F.lit("House")).alias("job_category"), F.lit("A new house").alias("job_description"),
        F.concat(F.lit("$ "), F.format_number(F.expr(price), 2)).alias("construction_value"), F.when(total.between(100_000, 105_000), "100001").when(c("o_orderstatus") == "O", "2.0").when(c("o_orderstatus") == "P", "12d").alias("units_added"),
        F.when(total < 5_000, "101A AVE NW").otherwise(F.concat(s(c("o_custkey") + 1), F.lit(" 5th Avenue NW"))).alias("address"), s(c("o_custkey") % 25).alias("neighbourhood_numberr"), F.concat(F.lit(" n"), s(c("o_custkey") % 25)).alias("neighbourhood"),
        F.when((c("o_orderstatus") == "F") & total.between(200_000, 210_000), F.concat(issued, F.lit("T00:00:00"))).when(c("o_orderstatus") == "F", issued).alias("occupancy_granted_date"), F.lit("53.5").alias("latitude"), F.lit("-113.5").alias("longitude"),
    )


@query("ingest_normalize", f"""
with {RAW_SQL}
select id as source_record_id, error_code, cast(o_orderdate as date) as issue_date, case when o_orderstatus = 'F' and not bad_occupancy then cast(o_orderdate as date) end as occupancy_date, printf('%.2f', o_totalprice) as construction_value,
       case when bad_units then 100001 when o_orderstatus = 'O' then 2 end as units, case when pr = '3' then 'Building Permit' else 'House' end as permit_type, case when bad_address then '' else 'edmonton|ab|' || (o_custkey + 1) || ' 5 ave nw' end as site_key
from tagged where id is not null and not bad_date""")
def ingest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an identifier and a readable date, as they are understood."""
    own = permits.normalize(raw_building(spark, sf_dir), DATASET).filter(F.col("source_record_id").isNotNull() & F.col("issue_date").isNotNull())
    return own.select("source_record_id", "error_code", "issue_date", "occupancy_date", "construction_value", F.col("units").cast("int").alias("units"), "permit_type", "site_key")


@query("quarantine", f"with {RAW_SQL} select error_code, count(*) as n, count(id) as with_id from tagged where error_code is not null group by 1")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = snapshot.quarantine(permits.normalize(raw_building(spark, sf_dir), DATASET))
    return bad.groupBy("error_code").agg(F.count("*").alias("n"), F.count_if(~F.col("record_key").startswith("invalid:")).alias("with_id"))


_OLD_PRICE = "case when o_orderstatus = 'O' then o_totalprice - 1 else o_totalprice end"


def _sides(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an earlier run left (orders placed before 2001, open ones at a lower price), what comes now (orders placed from
    1996 on), and what fails now: one pass makes both extracts uniform, and is checkpointed."""
    now, then = raw_building(spark, sf_dir), raw_building(spark, sf_dir, _OLD_PRICE)
    both = now.unionByName(then.withColumn(":id", F.concat(F.lit("old"), F.col("`:id`"))))
    own = permits.normalize(both, DATASET).select("system_id", "issue_date", "error_code", "record_key", "checksum", *columns)
    own = checkpointed(own.withColumn("old", F.col("system_id").startswith("old")).drop("system_id"))
    sound, day = F.col("error_code").isNull(), F.col("issue_date")
    stored = own.filter(F.col("old") & sound & (day < F.lit("2001-01-01").cast("date")))
    incoming = own.filter(~F.col("old") & sound & (day >= F.lit("1996-01-01").cast("date")))
    return stored.drop("old"), incoming.drop("old"), own.filter(~F.col("old") & ~sound)


_DIFF_SQL = f"""
{RAW_SQL}, sound as (select *, cast(o_orderdate as date) as d from tagged where error_code is null),
dif as (select id as record_key, case when d >= date '2001-01-01' then 'created' when d < date '1996-01-01' then 'absent' when o_orderstatus = 'O' then 'updated' else 'unchanged' end as disposition from sound)"""


@query("snapshot_diff", f"with {_DIFF_SQL} select record_key, disposition from dif")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming, _ = _sides(spark, sf_dir)
    return snapshot.diff(stored, incoming).select("record_key", "disposition")


@query("run_counters", f"""
with {_DIFF_SQL}, c as (select count(*) filter (where disposition = 'created') as created, count(*) filter (where disposition = 'updated') as updated, count(*) filter (where disposition = 'unchanged') as skipped, (select count(*) from tagged where error_code is not null) as failed from dif)
select created + updated + skipped + failed as fetched, created, updated, skipped, failed, case when failed > 0 then 'PARTIALLY_SUCCEEDED' else 'SUCCEEDED' end as status from c""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming, failed = _sides(spark, sf_dir)
    return snapshot.counters(snapshot.diff(stored, incoming), failed)


@query("snapshot_upsert", f"""
with {_DIFF_SQL}, s as (select id, d, o_orderstatus as st, o_totalprice as price from sound)
select id as record_key, printf('%.2f', case when st = 'O' and d < date '1996-01-01' then price - 1 else price end) as construction_value, 53.5::double as latitude,
       case when d >= date '2001-01-01' or (d >= date '1996-01-01' and st = 'O') then 'PENDING' else 'MATCHED' end as match_status, case when d >= date '2001-01-01' or (d >= date '1996-01-01' and st = 'O') then 1 else 2 end as normalization_version from s""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incoming rows over the stored ones, in a table of hash buckets: the second run writes a delta. Incoming coordinates
    are null and do not hide known ones; new rows have theirs."""
    columns = ["construction_value", "latitude", "longitude"]
    stored, incoming, _ = _sides(spark, sf_dir, *columns)
    state = {"match_status": F.lit("MATCHED"), "normalization_version": F.lit(snapshot.NORMALIZATION_VERSION)}
    fresh = F.col("issue_date") >= F.lit("2001-01-01").cast("date")
    root, kept = shared_path(spark, "upsert"), ["record_key", "checksum", "issue_date", *columns]
    buckets.create(stored.select(kept).withColumns(state), root, buckets=QUERY_BUCKETS)
    buckets.merge(incoming.withColumn("latitude", F.when(fresh, F.col("latitude"))).select(kept), root, lambda old, new: snapshot.upsert(old, new, changed_only=True))
    return buckets.read(spark, root, columns=["record_key", "construction_value", "latitude", "match_status", "normalization_version"])


_RUNS_SQL = f"""
{RAW_SQL}, o as (select *, cast(o_orderdate as date) as d, o_orderstatus as st from tagged)"""


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[imports.Run, str]:
    """An import of the orders placed before 2001, open ones at a lower price, and then one of all orders."""
    root, before = shared_path(spark, "imports"), "2001"
    imports.run(raw_building(spark, sf_dir, _OLD_PRICE).filter(F.col("permit_date") < before), DATASET, root, table_buckets=QUERY_BUCKETS)
    return imports.run(raw_building(spark, sf_dir), DATASET, root, table_buckets=QUERY_BUCKETS), root


@query("import_run", f"""
with {_RUNS_SQL}, bad as (select count(*) as n from (select distinct coalesce(id, 'invalid:' || o_orderkey) from o where error_code is not null)), c as (
  select count(*) filter (where d >= date '2001-01-01') as created, count(*) filter (where d < date '2001-01-01' and st = 'O') as updated, count(*) filter (where d < date '2001-01-01' and st <> 'O') as skipped from o where error_code is null)
select created + updated + skipped + bad.n as fetched, created, updated, skipped, bad.n as failed, case when bad.n > 0 then 'PARTIALLY_SUCCEEDED' else 'SUCCEEDED' end as status,
       cast(created + updated + bad.n as bigint) as parsed from c, bad""")
def import_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the second of two runs, and how many rows it parsed: those that are new, differ or failed before."""
    done, _ = _two_runs(spark, sf_dir)
    return done.counters.withColumn("parsed", F.lit(done.parsed).cast("long"))


@query("import_table", f"""
with {_RUNS_SQL} select id as record_key, printf('%.2f', o_totalprice) as construction_value, cast(d as date) as day, 'PENDING' as match_status, 1 as normalization_version from o where error_code is null""")
def import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permits that two runs leave: bases and deltas, read as one table."""
    own = imports.table(spark, _two_runs(spark, sf_dir)[1])
    return own.select("record_key", "construction_value", F.col("issue_date").alias("day"), "match_status", "normalization_version")


@query("paged_backfill", f"""
with {RAW_SQL}
select id as source_record_id, error_code, cast(o_orderdate as date) as issue_date, printf('%.2f', o_totalprice) as construction_value from tagged
where pr <> '4' and not bad_date and cast(o_orderdate as date) between date '1996-01-01' and date '1998-12-31'""")
def paged_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract as pages, read again for a range of dates: the source tests the dates and leaves other pages closed."""
    root = shared_path(spark, "pages")
    paged.write_pages(raw_building(spark, sf_dir), DATASET, root, "1700000000")
    own = permits.in_dates(paged.stable_rows(spark, DATASET, root), DATASET, "1996-01-01", "1998-12-31")
    return permits.normalize(own, DATASET).select("source_record_id", "error_code", "issue_date", "construction_value")


@query("duplicate_keys", "select cast(l_orderkey as varchar) || '-' || l_linenumber as record_key, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would stop a run: pairs of order and line that stand in the table more than once."""
    own = binding.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_key"))
    return snapshot.duplicates(own)


@query("payload_checksum", "select o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":' || case when o_orderstatus = 'P' then 'null' else '\"' || o_orderstatus || '\"' end || '}') as checksum from orders")
def payload_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binding.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return own.select("o_orderkey", permits.checksum(permits.payload(own)).alias("checksum"))


@query("neighbourhood_precedence", """
with seen as (select c_nationkey as k, max('permit ' || c_mktsegment) as p from customer group by 1)
select 'N' || n_nationkey as city_id, case when n_regionkey < 2 then 'City ' || n_name when n_regionkey = 2 then n_name when p is not null then p else 'old' end as name,
       case when n_regionkey <= 2 then 'CITY_CURRENT_CENTROIDS' else 'PERMIT' end as name_source, case when n_regionkey = 4 then 'created' when n_regionkey = 2 then 'unchanged' else 'updated' end as change
from nation left join seen on k = n_nationkey where n_regionkey <> 4 or p is not null""")
def neighbourhood_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions tell a name's state: 0 and 1 are on the city's list, 2 came from it before, 3 had a permit's, 4 are new."""
    c = F.col
    nations = binding.table(spark, sf_dir, "nation").withColumn("city_id", F.concat(F.lit("N"), c("n_nationkey").cast("string")))
    existing = nations.filter("n_regionkey <> 4").select("city_id", F.when(c("n_regionkey") == 2, c("n_name")).otherwise("old").alias("name"), F.when(c("n_regionkey") == 2, neighbourhoods.AUTHORITY).otherwise(neighbourhoods.FROM_PERMITS).alias("name_source"))
    authority = nations.filter("n_regionkey < 2").select("city_id", F.concat(F.lit("City "), c("n_name")).alias("name"))
    brought = binding.table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), c("c_nationkey").cast("string")).alias("city_id"), F.concat(F.lit("permit "), c("c_mktsegment")).alias("name"), F.lit(1).alias("observed_at"))
    return neighbourhoods.with_precedence(existing, brought, authority)


@query("failures_page", f"""
with {RAW_SQL}, f as (select o_orderkey, error_code, case when o_orderstatus = 'P' then 'SUCCEEDED' else 'PARTIALLY_SUCCEEDED' end as run_status, o_orderdate as created_at from tagged where error_code is not null)
select o_orderkey, error_code, run_status from f order by created_at desc, o_orderkey desc limit 25 offset 25""")
def failures_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the failures, with their runs."""
    from ..operators import readmodel

    _, bad = snapshot.quarantine(permits.normalize(raw_building(spark, sf_dir), DATASET))
    system = F.substring(F.get_json_object("payload", "$.permit_date"), 1, 10)
    keyed = bad.select(F.coalesce(F.when(~F.col("record_key").startswith("invalid:"), F.col("record_key"))).alias("record_key"), "error_code", system.alias("created_at"), "payload")
    # rows without an identifier are told apart by the order that has their price, customer and day
    orders = binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("failure_id"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_number("o_totalprice", 2).alias("price"))
    priced = keyed.withColumn("price", F.substring(F.get_json_object("payload", "$.construction_value"), 3, 40))
    own = priced.join(orders, (F.col("created_at") == F.col("day")) & (priced["price"] == orders["price"]) & (F.col("record_key").isNull() | (F.col("record_key") == F.col("o_orderkey").cast("string"))))
    own = own.withColumn("run_id", F.when(F.col("o_orderstatus") == "P", 2).otherwise(3))
    runs = spark.createDataFrame([(2, "SUCCEEDED"), (3, "PARTIALLY_SUCCEEDED")], "run_id int, status string")
    return readmodel.failures(own, runs, page_number=2).select("o_orderkey", "error_code", "run_status")


@query("neighbourhood_list", """
select cast(n_nationkey + 1 as varchar) as city_id, 'Old ' || n_name as name, coalesce(min(53.3::double + cast((c_custkey * 37) % 500 as double) / 1000.0::double) filter (where c_acctbal >= 0), 53.5::double) as latitude,
       coalesce(min((-113.8)::double + cast((c_custkey * 91) % 600 as double) / 1000.0::double) filter (where c_acctbal >= 0), (-113.5)::double) as longitude
from nation left join customer on c_nationkey = n_nationkey group by 1, 2""")
def neighbourhood_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authority's list, checked as a whole; as raw text, with blanks. A corner of a nation's sites stands for its centre."""
    c = F.col
    corner = binding.sites(spark, sf_dir).groupBy("neighbourhood_name").agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    nations = binding.table(spark, sf_dir, "nation").join(corner, c("n_name") == c("neighbourhood_name"), "left")
    raw = nations.select(
        F.concat(F.lit(" "), (c("n_nationkey") + 1).cast("string")).alias("number"), F.concat(F.lit(" Old  \t"), c("n_name"), F.lit(" ")).alias("name_mixed"),
        F.coalesce("lat", F.lit(53.5)).cast("string").alias("latitude"), F.coalesce("lon", F.lit(-113.5)).cast("string").alias("longitude"),
    )
    return neighbourhoods.checked(raw, rows=(25, 25))  # nations are a fixed list, shorter than the city's


@query("extract_columns", f"""
with {RAW_SQL}
select unnest(['row_id', 'issue_date', 'permit_date', 'job_category', 'units_added', 'occupancy_granted_date', 'zoning']) as column_name, count(*) as n_rows,
       unnest([count(id), count(*) filter (where bad_date or pr <> '4'), count(*), count(*) filter (where pr <> '3'), count(*) filter (where bad_units or o_orderstatus in ('O', 'P')), count(*) filter (where o_orderstatus = 'F'), 0]) as n_filled,
       true as seen from raw""")
def extract_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract of JSON lines: the rows that its metadata announce, how many of them fill a column, and whether a run that
    has seen it may stop before it reads a row."""
    path, names = shared_path(spark, "extract"), ["row_id", "issue_date", "permit_date", "job_category", "units_added", "occupancy_granted_date", "zoning"]
    raw_building(spark, sf_dir).write.json(path)
    raw = permits.read_json(spark, path, DATASET)
    first = permits.metadata(raw, DATASET)
    seen = snapshot.unchanged_revision(first, permits.metadata(raw, DATASET))
    counts = raw.agg(*[F.count(n).alias(n) for n in names])
    own = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n_filled")) for n in names])).alias("r")).select("r.*")
    return own.select("column_name", F.lit(first.row_count).cast("long").alias("n_rows"), "n_filled", F.lit(seen).alias("seen"))

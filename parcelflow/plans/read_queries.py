"""Lists, maps, facets, the dashboard, administration, saved searches and exports over the gold projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, filters, gramindex, readmodel
from ..session import dealt, shared_path
from ..sources import export
from . import binding
from .catalogue import query

FROM, THROUGH = "1999-01-01", "2000-12-31"
LIST = filters.ProjectFilters(min_confidence=20, sort="confidence", page=2, page_size=20)
SEARCH = filters.ProjectFilters(q="p-12", scope="core")
MAP = filters.ProjectFilters(scope="core", sort="value")
CSV = filters.ProjectFilters(categories=("PROBABLE_SEMI_DETACHED_INFILL", "DEMOLITION_ONLY"), start=FROM)

_DATE = lambda text: F.to_date(F.lit(text))
_LABEL = """case category when 'PROBABLE_NEW_DETACHED_INFILL' then 'Probable new detached infill' when 'PROBABLE_SEMI_DETACHED_INFILL' then 'Probable semi-detached infill'
  when 'DEMOLITION_ONLY' then 'Demolition only' when 'RENOVATION_OR_ADDITION' then 'Renovation or addition' end"""
_STAGE_LABEL = "case stage when 'COMPLETE' then 'Occupancy reported' when 'BUILDING_PERMIT' then 'Building permit' when 'DEVELOPMENT_PERMIT' then 'Development permit' when 'DEMOLITION' then 'Demolition' when 'DISCOVERED' then 'Discovered' end"
_EVENT_TYPE = "case kind when 'new' then 'Single Detached House' when 'demo' then 'Demolition' when 'form' then 'Development Permit' when 'reno' then 'Home Improvement Permit' when 'shop' then 'Commercial Final' else 'Accessory Building' end"
_SUBTYPE = "case kind when 'new' then '(01) New' when 'demo' then null when 'form' then 'Class A' when 'shed' then '(01) New' else '(03) Interior Alteration' end"
_STATUS = "case st when 'P' then 'Cancelled' when 'F' then 'Issued' else 'Approved' end"
_LAST_SQL = f"last_ev as (select project_id, {_EVENT_TYPE} as permit_type, {_SUBTYPE} as permit_subtype, {_STATUS} as status, issue_date as event_date from (select *, row_number() over (partition by project_id order by issue_date desc, event_id desc) as n from ev) where n = 1)"


@query("list_projects", f"""
with {binding.GOLD_SQL}, {_LAST_SQL},
page as (select * from public where confidence >= 20 order by confidence desc, project_id limit 20 offset 20)
select project_id, title, street, neighbourhood_name, {_LABEL} as category_label, {_STAGE_LABEL} as stage_label, cast(confidence as integer) as confidence, permit_type, status as permit_status, event_date from page left join last_ev using (project_id)""")
def list_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = readmodel.page(binding.gold(spark, sf_dir), binding.permits(spark, sf_dir), LIST)
    return own.select("project_id", "title", "street", "neighbourhood_name", "category_label", "stage_label", "confidence", "latest_event.permit_type", F.col("latest_event.status").alias("permit_status"), F.col("latest_event.date").alias("event_date"))


@query("page_totals", f"with {binding.GOLD_SQL} select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as total_pages from public where confidence >= 20")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.totals(binding.gold(spark, sf_dir), binding.permits(spark, sf_dir), LIST)


@query("text_search_exists", f"with {binding.GOLD_SQL} select project_id, category from public where area_class = 'CORE' and (contains(lower(title), 'p-12') or contains(lower(street), 'p-12') or project_id in (select project_id from ev where contains(lower(permit_number), 'p-12')))")
def text_search_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(binding.gold(spark, sf_dir), SEARCH, binding.permits(spark, sf_dir)).select("project_id", F.col("effective_category").alias("category"))


@query("text_search_index", f"with {binding.GOLD_SQL} select project_id, category from public where area_class = 'CORE' and (contains(lower(title), 'p-12') or contains(lower(street), 'p-12') or project_id in (select project_id from ev where contains(lower(permit_number), 'p-12')))")
def text_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index of titles, streets and permit numbers, which is built here and would be kept."""
    sites, root = binding.sites(spark, sf_dir), shared_path(spark, "grams")
    texts = sites.select("project_id", F.explode(F.array("title", "street")).alias("text")).unionByName(binding.permits(spark, sf_dir).select("project_id", F.col("permit_number").alias("text")))
    gramindex.build(texts, root)
    found = filters.apply_found(binding.gold(spark, sf_dir), SEARCH, gramindex.search(spark, root, SEARCH.q))
    return found.select("project_id", F.col("effective_category").alias("category"))


@query("markers", f"""
with {binding.GOLD_SQL}, placed as (select *, row_number() over (order by value desc nulls last, project_id) as n, count(*) over () as total from public where area_class = 'CORE' and latitude is not null)
select project_id, category, stage, cast(confidence as integer) as confidence, round(latitude, 6) as latitude, round(longitude, 6) as longitude, total > 100 as truncated from placed where n <= 100""")
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = readmodel.markers(binding.gold(spark, sf_dir), MAP, limit=100)
    return own.select("project_id", "category", "stage", "confidence", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "truncated")


@query("missing_coordinates", f"with {binding.GOLD_SQL} select count(*) filter (where latitude is null) as missing from public")
def missing_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.missing_coordinates(binding.gold(spark, sf_dir), filters.ProjectFilters())


@query("geojson", f"""
with {binding.GOLD_SQL}
select project_id, category as feature_category, title as feature_title, 'Point' as kind from public where latitude between 53.2 and 53.9 and longitude between -114.0 and -113.0""")
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of everything that a map can show, with what reads back from their JSON."""
    own = readmodel.mappable(binding.gold(spark, sf_dir).filter(filters.is_public())).withColumn("category", F.col("effective_category"))
    found = export.features(own)
    at = lambda path: F.get_json_object("feature", path)
    return found.select("project_id", at("$.properties.category").alias("feature_category"), at("$.properties.title").alias("feature_title"), at("$.geometry.type").alias("kind"))


_CATEGORY_LIST = ", ".join(f"('category', '{c}', '{binding.project.text.LABELS[c]}')" for c in filters.PUBLIC_CATEGORIES)
_STAGE_LIST = ", ".join(f"('stage', '{s}', '{binding.project.text.LABELS[s]}')" for s in filters.STAGES)


@query("facets", f"""
with {binding.GOLD_SQL}, fixed(facet, value, label) as (values {_CATEGORY_LIST}, {_STAGE_LIST}),
c as (select 'category' as facet, category as value, count(*) as n from public group by 2 union all select 'stage', stage, count(*) from public group by 2)
select facet, value, label, coalesce(n, 0) as n from fixed left join c using (facet, value)
union all select 'neighbourhood', neighbourhood_id, min(neighbourhood_name), count(*) from public group by 2""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.facets(binding.gold(spark, sf_dir))


@query("lifecycle_counts", f"""
with {binding.GOLD_SQL}, core as (select project_id from public where area_class = 'CORE'), own as (select * from ev join core using (project_id) where role not in ('PROPERTY_ONLY', 'EXCLUDED'))
select count(*) filter (where dataset = 'development' and issue_date between date '{FROM}' and date '{THROUGH}') as development, count(*) filter (where dataset = 'building' and issue_date between date '{FROM}' and date '{THROUGH}') as building,
       count(*) filter (where occupancy_date between date '{FROM}' and date '{THROUGH}') as occupancy from own""")
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.lifecycle_counts(binding.assessed(spark, sf_dir), binding.gold(spark, sf_dir), _DATE(FROM), _DATE(THROUGH))


@query("starts", f"with {binding.GOLD_SQL} select count(*) as starts from public where area_class = 'CORE' and category <> 'RENOVATION_OR_ADDITION' and infill_start_date between date '{FROM}' and date '{THROUGH}'")
def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.starts(binding.gold(spark, sf_dir), _DATE(FROM), _DATE(THROUGH))


_ACTIVE = f"active as (select * from public where area_class = 'CORE' and latest_infill_activity_date between date '{FROM}' and date '{THROUGH}')"


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.active_core(binding.gold(spark, sf_dir), _DATE(FROM), _DATE(THROUGH))


@query("overview_categories", f"with {binding.GOLD_SQL}, {_ACTIVE} select category, {_LABEL} as label, count(*) as n from active group by 1")
def overview_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.category_breakdown(_active(spark, sf_dir)).select("category", "label", "n")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.sites(spark, sf_dir).select("address_id", "neighbourhood_id", "latitude", "longitude")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("neighbourhood_id"), F.col("n_name").alias("neighbourhood_name"))


@query("overview_neighbourhoods", f"with {binding.GOLD_SQL}, {_ACTIVE} select neighbourhood_id, min(neighbourhood_name) as neighbourhood_name, count(*) as n, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude from active group by 1")
def overview_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = readmodel.neighbourhood_breakdown(_active(spark, sf_dir), _addresses(spark, sf_dir), _names(spark, sf_dir))
    return own.select("neighbourhood_id", "neighbourhood_name", "n", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("map_projects", f"""
with {binding.GOLD_SQL}, {_ACTIVE}, top as (select neighbourhood_id from active group by 1 order by count(*) desc, min(neighbourhood_name) limit 10)
select project_id, neighbourhood_id, street, cast(confidence as integer) as confidence from active join top using (neighbourhood_id) where latitude is not null order by latest_infill_activity_date desc, project_id limit 5000""")
def map_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _active(spark, sf_dir)
    found = readmodel.map_projects(own, own.groupBy("neighbourhood_id").agg(F.count("*").alias("n"), F.min("neighbourhood_name").alias("name")).orderBy(F.desc("n"), "name"))
    return found.select("project_id", "neighbourhood_id", "street", "confidence")


@query("high_confidence_top5", f"with {binding.GOLD_SQL}, {_ACTIVE} select project_id, cast(confidence as integer) as confidence, latest_infill_activity_date from active where confidence >= 80 order by confidence desc, latest_infill_activity_date desc, project_id limit 5")
def high_confidence_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.high_confidence(_active(spark, sf_dir)).select("project_id", "confidence", "latest_infill_activity_date")


_RECENT = """own as (select e.* from ev e join active using (project_id) where {test} and e.issue_date between date '{a}' and date '{z}'),
first_ev as (select * from (select *, row_number() over (partition by project_id order by issue_date desc, event_id) as n from own) where n = 1)
select project_id, event_id, issue_date as date from first_ev order by issue_date desc, event_id limit 5"""


@query("recent_demolitions", f"with {binding.GOLD_SQL}, {_ACTIVE}, " + _RECENT.format(test="e.role = 'PRINCIPAL_DEMOLITION'", a=FROM, z=THROUGH))
def recent_demolitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.recent_projects(binding.assessed(spark, sf_dir), _active(spark, sf_dir), ["demolition", "demolish"], F.col("demolition"), _DATE(FROM), _DATE(THROUGH)).select("project_id", "event_id", "date")


@query("recent_projects", f"with {binding.GOLD_SQL}, {_ACTIVE}, " + _RECENT.format(test="e.role = 'PRINCIPAL_RESIDENTIAL'", a=FROM, z=THROUGH))
def recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ["new construction", "new dwelling", "construct", "erect", "building"]
    return readmodel.recent_projects(binding.assessed(spark, sf_dir), _active(spark, sf_dir), terms, F.col("new_residential"), _DATE(FROM), _DATE(THROUGH)).select("project_id", "event_id", "date")


RUNS = [(1, "SUCCEEDED", "2001-11-01 00:00:00", "2001-11-01 01:00:00", 0), (2, "SUCCEEDED", "2001-11-20 00:00:00", "2001-11-20 01:00:00", 0), (3, "PARTIALLY_SUCCEEDED", "2001-11-28 00:00:00", "2001-11-28 01:00:00", 7)]
NOW = "2001-12-01 12:00:00"


def _runs(spark: SparkSession) -> DataFrame:
    own = spark.createDataFrame(RUNS, "run_id int, status string, created_at string, completed_at string, records_failed int")
    return own.withColumns({n: F.col(n).cast("timestamp") for n in ("created_at", "completed_at")})


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits, of which those of shops belong to no project."""
    return binding.permits(spark, sf_dir).withColumn("project_id", F.when(F.col("kind") != "shop", F.col("project_id")))


@query("warnings", f"""
with {binding.GOLD_SQL}
select 'IMPORT_WARNINGS' as code, 'warning' as severity, cast(7 as bigint) as n union all select 'STALE_IMPORT', 'warning', null
union all select 'UNMATCHED_PERMITS', 'warning', count(*) from ev where kind = 'shop' having count(*) > 0
union all select 'MISSING_COORDINATES', 'info', count(*) from public where latitude is null having count(*) > 0
union all select 'UNCLASSIFIED_INFILL_AREA', 'info', count(*) from public where area_class = 'UNKNOWN' and latest_infill_activity_date between date '{FROM}' and date '{THROUGH}' having count(*) > 0""")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.warnings(binding.gold(spark, sf_dir), _loose(spark, sf_dir), _runs(spark), F.lit(NOW).cast("timestamp"), _DATE(FROM), _DATE(THROUGH))


@query("admin_summary", f"""
with {binding.GOLD_SQL}
select count(*) filter (where merged_into is null and review_status = 'PENDING') as pending_review, count(*) filter (where merged_into is null and review_status = 'CORRECTED') as corrected,
       count(*) filter (where merged_into is null and requires_market_review) as market_review_required, count(*) filter (where merged_into is not null) as merged,
       (select count(*) from ev where kind = 'shop') as unassigned_permits, (select count(*) from events where event_type = 'error') as failed_raw_records, 'PARTIALLY_SUCCEEDED' as latest_import_status,
       (select event_type from events where event_type <> 'error' order by ts desc, event_id desc limit 1) as latest_job_status from gold""")
def admin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = binding.table(spark, sf_dir, "events")
    raw = events.select(F.when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSED").alias("status"))
    jobs = events.filter("event_type <> 'error'").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return readmodel.admin_summary(binding.gold(spark, sf_dir), _loose(spark, sf_dir), raw, _runs(spark), jobs)


@query("admin_health", f"""
with {binding.EV_SQL}, j as (select event_id, ts, event_type, cast(json_extract(props, '$.k') as integer) as k from events)
select count(*) filter (where event_type = 'view') as pending_jobs, count(*) filter (where event_type = 'click') as running_jobs, count(*) filter (where event_type = 'click' and ts <= timestamp '2024-01-15 00:00:00') as expired_leases,
       max(ts) filter (where event_type = 'purchase' and k = 7) as last_scheduled_at, timestamp '2001-11-28 01:00:00' as last_completed_at, (select count(*) from ev where kind = 'shop') as unmatched,
       max(ts) filter (where event_type = 'purchase' and k = 7) + interval 24 hour as next_run_at, coalesce(max(ts) filter (where event_type = 'purchase' and k = 7) + interval 24 hour <= timestamp '2024-01-15 00:00:00', true) as overdue, 'attention' as state from j""")
def admin_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for jobs: views wait, clicks run, purchases with the key 7 came from the scheduler."""
    c = F.col
    jobs = binding.table(spark, sf_dir, "events").select(
        F.when(c("event_type") == "view", "PENDING").when(c("event_type") == "click", "RUNNING").otherwise("SUCCEEDED").alias("status"), F.when(c("event_type") == "purchase", "INCREMENTAL_PERMIT_IMPORT").otherwise("OTHER").alias("job_type"),
        F.to_json(F.struct(F.when(F.get_json_object("props", "$.k") == "7", "scheduler").otherwise("admin").alias("source"))).alias("metadata"), c("ts").alias("lock_expires_at"), c("ts").alias("created_at"),
    )
    quality = _loose(spark, sf_dir).agg(F.lit(0).alias("quarantined"), F.count_if(c("project_id").isNull()).alias("unmatched"), F.lit(0).alias("pending"), F.lit(0).alias("market"))
    runs = _runs(spark).withColumn("completed_at", c("completed_at").cast("timestamp_ntz"))
    return readmodel.health(jobs, runs, quality, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).drop("quarantined", "pending", "market")


@query("review_queue", f"""
with {binding.GOLD_SQL}
select project_id, requires_market_review, cast(confidence as integer) as confidence, row_number() over (order by requires_market_review desc, confidence, latest_infill_activity_date desc nulls last, project_id) <= 50 as first_page from gold where merged_into is null and review_status = 'PENDING'""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = readmodel.review_queue(binding.gold(spark, sf_dir), "pending")
    first = own.limit(50).select("project_id", F.lit(True).alias("first_page"))
    return own.select("project_id", "requires_market_review", "confidence").join(first, "project_id", "left").withColumn("first_page", F.coalesce("first_page", F.lit(False)))


@query("visible_markers", f"""
with {binding.GOLD_SQL}, {_ACTIVE}
select project_id from active where latitude between 53.5 and 53.6 and longitude between -113.6 and -113.4 order by confidence desc, power(latitude - 53.55, 2) + power(longitude + 113.5, 2), project_id limit 250""")
def visible_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.visible_markers(_active(spark, sf_dir), (53.5, -113.6, 53.6, -113.4), (53.55, -113.5)).select("project_id")


@query("visible_markers_cells", f"""
with {binding.GOLD_SQL}, {_ACTIVE}
select project_id from active where latitude between 53.5 and 53.6 and longitude between -113.6 and -113.4 order by confidence desc, power(latitude - 53.55, 2) + power(longitude + 113.5, 2), project_id limit 250""")
def visible_markers_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same markers from projects stored by cells."""
    box, root = (53.5, -113.6, 53.6, -113.4), shared_path(spark, "placed")
    number = readmodel.store_placed(_active(spark, sf_dir).select("project_id", "latitude", "longitude", "confidence"), root)
    return readmodel.visible_markers(readmodel.placed_within(spark, root, box, number), box, (53.55, -113.5)).select("project_id")


SEARCHES = [
    (1, "ann", True, ["NATION_1", "N2"], [], [], [], None, None, None, None, 20), (2, "ann", True, [], ["PROBABLE_SEMI_DETACHED_INFILL"], [], ["Issued"], 100000.0, 400000.0, None, None, None),
    (3, "ben", False, [], [], [], [], None, None, None, None, None), (4, "cat", True, [], [], ["COMPLETE"], [], None, None, 2, None, 50), (5, "cat", True, None, [], [], ["cancelled"], None, None, None, 1, None),
]
_SEARCH_SCHEMA = "search_id int, user_id string, active boolean, neighbourhoods array<string>, categories array<string>, stages array<string>, statuses array<string>, min_value double, max_value double, min_units int, max_units int, min_confidence int"


def _search_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = readmodel.latest_events(dealt(binding.permits(spark, sf_dir, even=False), "project_id")).select("project_id", F.col("latest_event.status").alias("permit_status"))
    return binding.gold(spark, sf_dir).join(last, "project_id", "left")


@query("saved_search", f"""
with {binding.GOLD_SQL}, {_LAST_SQL}, p as (select g.*, l.status from gold g left join last_ev l using (project_id)),
m as (
  select 1 as search_id, project_id, neighbourhood_id in ('N1', 'N2') and coalesce(confidence >= 20, false) as matches, neighbourhood_id not in ('N1', 'N2') as nb, false as st from p
  union all select 2, project_id, category = 'PROBABLE_SEMI_DETACHED_INFILL' and coalesce(status = 'Issued', false) and coalesce(value between 100000 and 400000, false), false, not coalesce(status = 'Issued', false) from p
  union all select 3, project_id, false, false, false from p
  union all select 4, project_id, stage = 'COMPLETE' and coalesce(units >= 2, false) and coalesce(confidence >= 50, false), false, false from p
  union all select 5, project_id, coalesce(status = 'Cancelled', false) and coalesce(units <= 1, false), false, not coalesce(status = 'Cancelled', false) from p)
select search_id, project_id, matches, nb as neighbourhood_fails, st as status_fails from m""")
def saved_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project with what speaks against each search."""
    own = alerts.evaluate(_search_projects(spark, sf_dir), spark.createDataFrame(SEARCHES, _SEARCH_SCHEMA))
    has = lambda code: F.array_contains("mismatches", code)
    return own.select("search_id", "project_id", "matches", has("neighbourhood").alias("neighbourhood_fails"), has("permit-status").alias("status_fails"))


@query("alert_dedupe", """
with keyed as (select 'alert:v1:user%20' || user_id || ':' || event_type as k, min(event_id) as search_id from events group by 1),
sent as (select distinct 'alert:v1:user%20' || user_id || ':' || event_type as k from events where value > 300)
select k as alert_key, search_id from keyed where k not in (select k from sent)""")
def alert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user hears of an event type once; those that a large event already told of, not again."""
    c = F.col
    own = binding.table(spark, sf_dir, "events").select(F.concat(F.lit("user "), c("user_id").cast("string")).alias("user_id"), c("event_type").alias("event_id"), c("event_id").alias("search_id"), c("value").alias("project_id"))
    sent = own.filter("project_id > 300").select(alerts.alert_key(c("user_id"), c("event_id")).alias("alert_key"))
    return alerts.new_alerts(own, sent).select("alert_key", "search_id")


@query("csv_export", f"""
with {binding.GOLD_SQL}, {_LAST_SQL}
select project_id, concat_ws(',', street, neighbourhood_name, {_LABEL}, {_STAGE_LABEL}, confidence, strftime(infill_start_date, '%Y-%m-%d'), strftime(latest_infill_activity_date, '%Y-%m-%d'), coalesce(cast(units as varchar), ''),
  rtrim(rtrim(printf('%.2f', value), '0'), '.'), case review_status when 'PENDING' then 'Pending review' when 'CONFIRMED' then 'Confirmed' else 'Corrected' end, permit_type, coalesce(permit_subtype, ''), status, '/projects/' || project_id) as line
from public join last_ev using (project_id) where category in ('PROBABLE_SEMI_DETACHED_INFILL', 'DEMOLITION_ONLY') and latest_infill_activity_date >= date '{FROM}'""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_lines(readmodel.export(binding.gold(spark, sf_dir), binding.permits(spark, sf_dir), CSV))

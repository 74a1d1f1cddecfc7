"""Read models over gold projects and silver permits: lists, markers, facets, dashboard and administration.

Projects have the columns of ``project.states`` and title, street, address_id, latitude, longitude, neighbourhood_id,
neighbourhood_name, area_class, review_status, merged_into. Permits have project_id and the columns of an event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PUBLIC_CATEGORIES, REVIEW_STATUSES, STAGES, START_CATEGORIES
from ..functions import cells, dates, geo, text
from ..session import dealt
from ..sources import snapshot
from . import assess, timeline
from .filters import ProjectFilters, apply, is_public, order_by

#: What stands for an explanation that can't be read.
NO_EXPLANATION = "There is no explanation for this score."
#: Projects whose details one call gives, at most.
DETAILS = 100
HIGH_CONFIDENCE = 80
MARKERS, MARKERS_MOST, MAP_PROJECTS, NEIGHBOURHOODS = 2_000, 10_000, 5_000, 10


def latest_events(permits: DataFrame) -> DataFrame:
    """(project_id, latest_event): the permit with the greatest event date, then event_id. Aggregates of structs sort what
    they get, so that permits which are many should be dealt by project before (``session.dealt``)."""
    return permits.groupBy("project_id").agg(F.max_by(F.struct(F.col("project_event_date").alias("date"), "permit_type", "permit_subtype", "status"), F.struct("project_event_date", "event_id")).alias("latest_event"))


def list_items(projects: DataFrame) -> DataFrame:
    c = F.col
    return projects.select(
        "project_id", "title", "street", "latitude", "longitude", "neighbourhood_id", "neighbourhood_name", c("effective_category").alias("category"), text.label(c("effective_category")).alias("category_label"),
        c("effective_stage").alias("stage"), text.label(c("effective_stage")).alias("stage_label"), "confidence", "infill_start_date", "latest_infill_activity_date", "units", "value",
        "review_status", text.label(c("review_status")).alias("review_status_label"), *(["latest_event"] if "latest_event" in projects.columns else []),
    )


def page(projects: DataFrame, permits: DataFrame, filters: ProjectFilters) -> DataFrame:
    """One page of the list. Only the page's own projects meet the permits again, for their latest event."""
    found = apply(projects, filters, permits).orderBy(*order_by(filters)).offset((filters.page - 1) * filters.page_size).limit(filters.page_size)
    events = latest_events(permits.join(F.broadcast(found.select("project_id")), "project_id", "left_semi"))  # a page has 100 rows at most
    return list_items(found.join(events, "project_id", "left")).orderBy(*order_by_output(filters))


def order_by_output(filters: ProjectFilters) -> list[Column]:
    return order_by(filters) if filters.sort not in ("category", "stage") else ["project_id"]


def totals(projects: DataFrame, permits: DataFrame, filters: ProjectFilters) -> DataFrame:
    """total and total_pages (0 for none)."""
    return apply(projects, filters, permits).agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / filters.page_size))


def export(projects: DataFrame, permits: DataFrame, filters: ProjectFilters) -> DataFrame:
    """Every project that passes, for the CSV sink, unsorted (the sink sorts)."""
    return list_items(apply(projects, filters, permits).join(latest_events(dealt(permits, "project_id")), "project_id", "left"))


def markers(projects: DataFrame, filters: ProjectFilters, permits: DataFrame | None = None, limit: int = MARKERS) -> DataFrame:
    """Markers of projects with coordinates, ``limit`` at most, and ``truncated``: whether there were more."""
    limit = min(limit, MARKERS_MOST)
    placed = apply(projects, filters, permits).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    some = placed.orderBy(*order_by(filters)).limit(limit + 1).select("project_id", "title", "street", "latitude", "longitude", F.col("effective_category").alias("category"), F.col("effective_stage").alias("stage"), "confidence", F.row_number().over(Window.orderBy(*order_by(filters))).alias("_n"))
    return some.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > limit).filter(F.col("_n") <= limit).drop("_n")  # limit + 1 rows at most


def missing_coordinates(projects: DataFrame, filters: ProjectFilters, permits: DataFrame | None = None) -> DataFrame:
    return apply(projects, filters, permits).agg(F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing"))


def mappable(projects: DataFrame) -> DataFrame:
    """Projects whose coordinates a map of the city can show."""
    return projects.filter(geo.within(F.col("latitude"), F.col("longitude"), geo.MAP_ENVELOPE))


def visible_markers(neighbourhoods: DataFrame, bounds: tuple[float, float, float, float], centre: tuple[float, float], limit: int = 250) -> DataFrame:
    """Markers within (south, west, north, east): by confidence, then by squared distance to the centre."""
    south, west, north, east = bounds
    distance = F.pow(F.col("latitude") - centre[0], 2) + F.pow(F.col("longitude") - centre[1], 2)
    inside = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    return neighbourhoods.filter(inside).orderBy(F.col("confidence").desc(), distance, "project_id").limit(limit)


def store_placed(projects: DataFrame, root: str) -> int:
    """Publish projects in the order of their cells, with the column ``cell``; the number of the manifest. Projects without
    coordinates come first, which no box reads."""
    own = projects.withColumn("cell", cells.cell(F.col("latitude"), F.col("longitude")))
    snapshot.publish(own.repartitionByRange("cell", "project_id").sortWithinPartitions("cell", "project_id"), root)
    return snapshot.newest(projects.sparkSession, root)[1]["number"]


def placed_within(spark: SparkSession, root: str, bounds: tuple[float, float, float, float], number: int | None = None) -> DataFrame:
    """The stored projects within (south, west, north, east): ranges of cells skip files and row groups, then the coordinates
    decide."""
    own = snapshot.published(spark, root, number)
    if own is None:
        raise FileNotFoundError(f"no projects in {root}")
    south, west, north, east = bounds
    return own.filter(cells.within(F.col("cell"), bounds)).filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def marker_diameter(count: Column, largest: Column) -> Column:
    return 40 + F.floor(count / largest * 22 + 0.5)


def facets(projects: DataFrame) -> DataFrame:
    """(facet, value, label, n): neighbourhoods that have projects; categories and stages with zeros. One aggregation."""
    spark = projects.sparkSession
    c = F.col
    public = projects.filter(is_public())
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), v.alias("value"), l.alias("label")) for f, v, l in (("neighbourhood", c("neighbourhood_id"), c("neighbourhood_name")), ("category", c("effective_category"), F.lit(None).cast("string")), ("stage", c("effective_stage"), F.lit(None).cast("string")))])
    counted = public.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"), F.min("p.label").alias("name"))
    fixed = spark.createDataFrame([("category", v) for v in PUBLIC_CATEGORIES] + [("stage", v) for v in STAGES], "facet string, value string")
    zeros = F.broadcast(fixed).join(counted.filter("facet <> 'neighbourhood'"), ["facet", "value"], "left").select("facet", "value", text.label(c("value")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    return counted.filter("facet = 'neighbourhood' and value is not null and name is not null").select("facet", "value", c("name").alias("label"), "n").unionByName(zeros)


def lifecycle_counts(permits: DataFrame, projects: DataFrame, start: Column, through: Column) -> DataFrame:
    """development, building and occupancy permits in the range, of public projects of the core area; a building permit
    may count as issued and as occupied. Permits have a role."""
    own = permits.filter(~F.col("role").isin("PROPERTY_ONLY", "EXCLUDED")).join(projects.filter(is_public() & (F.col("area_class") == "CORE")).select("project_id"), "project_id", "left_semi")
    issued, occupied = dates.in_range(F.col("issue_date"), start, through), dates.in_range(F.col("occupancy_date"), start, through)
    is_ = lambda name: F.col("dataset") == name
    return own.agg(F.count_if(is_("development") & issued).alias("development"), F.count_if(is_("building") & issued).alias("building"), F.count_if(is_("building") & occupied).alias("occupancy"))


def starts(projects: DataFrame, start: Column, through: Column) -> DataFrame:
    """Public core projects of a start category whose infill began in the range."""
    core = is_public() & (F.col("area_class") == "CORE") & F.col("effective_category").isin(START_CATEGORIES)
    return projects.agg(F.count_if(core & dates.in_range(F.col("infill_start_date"), start, through)).alias("starts"))


def active_core(projects: DataFrame, start: Column, through: Column) -> DataFrame:
    return projects.filter(is_public() & (F.col("area_class") == "CORE") & dates.in_range(F.col("latest_infill_activity_date"), start, through))


def category_breakdown(active: DataFrame) -> DataFrame:
    own = active.groupBy(F.col("effective_category").alias("category")).agg(F.count("*").alias("n"))
    return own.withColumn("label", text.label(F.col("category"))).orderBy(F.desc("n"), F.collate("label", "UNICODE"))


def neighbourhood_breakdown(active: DataFrame, addresses: DataFrame, neighbourhoods: DataFrame) -> DataFrame:
    """Projects of each named neighbourhood, with the mean coordinates of its addresses that have an active project:
    each address once, and by the address's own neighbourhood, which may be another than the project's."""
    counted = active.groupBy("neighbourhood_id").agg(F.count("*").alias("n"))
    used = addresses.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).join(active.select("address_id").distinct(), "address_id", "left_semi")
    centre = used.groupBy("neighbourhood_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    return counted.join(neighbourhoods, "neighbourhood_id").join(centre, "neighbourhood_id", "left").orderBy(F.desc("n"), F.collate("neighbourhood_name", "UNICODE"))


def map_projects(active: DataFrame, breakdown: DataFrame, top: int = NEIGHBOURHOODS, limit: int = MAP_PROJECTS) -> DataFrame:
    """Projects with coordinates in the leading neighbourhoods."""
    leading = F.broadcast(breakdown.limit(top).select("neighbourhood_id"))  # ``top`` rows
    placed = active.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).join(leading, "neighbourhood_id", "left_semi")
    return placed.orderBy(F.col("latest_infill_activity_date").desc_nulls_last(), "project_id").limit(limit).select("project_id", "neighbourhood_id", "street", "latitude", "longitude", "confidence")


def high_confidence(active: DataFrame, limit: int = 5) -> DataFrame:
    return active.filter(F.col("confidence") >= HIGH_CONFIDENCE).orderBy(F.desc("confidence"), F.col("latest_infill_activity_date").desc_nulls_last(), "project_id").limit(limit)


def mentions(terms: list[str]) -> Column:
    """Whether a permit's type, subtype or description holds any of the terms, without case."""
    found = [F.coalesce(F.lower(F.col(name)).contains(t.lower()), F.lit(False)) for name in ("permit_type", "permit_subtype", "description") for t in terms]
    return reduce(lambda a, b: a | b, found)


def recent_projects(permits: DataFrame, projects: DataFrame, terms: list[str], accepts: Column, start: Column, through: Column, limit: int = 5) -> DataFrame:
    """The projects with the latest qualifying permits, each by its own latest one: (project_id, event_id, date, ...).

    A permit qualifies by its text, by ``accepts`` (of the assessed permit) and by its issue date, or application date
    where it has none. ``projects`` are the ones that count. One partial aggregate, then a top-k.
    """
    civic = F.coalesce("issue_date", "application_date")
    own = permits.filter(mentions(terms) & accepts & dates.in_range(civic, start, through)).join(projects.select("project_id"), "project_id", "left_semi")
    best = own.groupBy("project_id").agg(F.min_by(F.struct("event_id", civic.alias("date"), "permit_type", "permit_subtype", "status"), F.struct((-F.unix_date("project_event_date")).alias("d"), "event_id")).alias("e"), F.max("project_event_date").alias("_latest"))
    return best.orderBy(F.desc("_latest"), "e.event_id").limit(limit).select("project_id", "e.*")


def warnings(projects: DataFrame, permits: DataFrame, runs: DataFrame, now: Column, start: Column, through: Column) -> DataFrame:
    """(code, severity, n): the dashboard's warnings, each with the scope that it has. ``runs``: run_id, status,
    created_at, completed_at, records_failed."""
    latest = runs.agg(F.count("*").alias("n"), F.max_by(F.struct("status", "records_failed"), F.struct("created_at", "run_id")).alias("r"), F.max(F.when(F.col("status").isin("SUCCEEDED", "PARTIALLY_SUCCEEDED"), F.col("completed_at"))).alias("done"))
    counts = projects.agg(
        F.count_if(is_public() & (F.col("latitude").isNull() | F.col("longitude").isNull())).alias("missing"),
        F.count_if(is_public() & (F.col("area_class") == "UNKNOWN") & dates.in_range(F.col("latest_infill_activity_date"), start, through)).alias("unclassified"),
    )
    unmatched = permits.agg(F.count_if(F.col("project_id").isNull()).alias("unmatched"))
    one = latest.join(counts, F.lit(True)).join(unmatched, F.lit(True))  # three rows of one line each
    w = lambda test, code, severity, n=None: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None) if n is None else n).cast("long").alias("n")))
    c = F.col
    state = F.coalesce(
        w(c("n") == 0, "NO_IMPORT", "info"), w(c("r.status") == "FAILED", "IMPORT_FAILED", "error", c("r.records_failed")),
        w((c("r.status") == "PARTIALLY_SUCCEEDED") | (c("r.records_failed") > 0), "IMPORT_WARNINGS", "warning", c("r.records_failed")),
    )
    found = F.array(
        state, w(c("done") < now - F.expr("interval 48 hours"), "STALE_IMPORT", "warning"), w(c("unmatched") > 0, "UNMATCHED_PERMITS", "warning", c("unmatched")),
        w(c("missing") > 0, "MISSING_COORDINATES", "info", c("missing")), w(c("unclassified") > 0, "UNCLASSIFIED_INFILL_AREA", "info", c("unclassified")),
    )
    return one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("w")).select("w.*")


def admin_summary(projects: DataFrame, permits: DataFrame, raw: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    live = F.col("merged_into").isNull()
    status = lambda of: F.col("review_status") == of
    p = projects.agg(
        F.count_if(live & status("PENDING")).alias("pending_review"), F.count_if(live & status("CORRECTED")).alias("corrected"),
        F.count_if(live & F.col("requires_market_review")).alias("market_review_required"), F.count_if(~live).alias("merged"),
    )
    e = permits.agg(F.count_if(F.col("project_id").isNull()).alias("unassigned_permits"))
    f = raw.agg(F.count_if(F.col("status") == "FAILED").alias("failed_raw_records"))
    r = runs.agg(F.max_by("status", F.struct("created_at", "run_id")).alias("latest_import_status"))
    j = jobs.agg(F.max_by("status", F.struct("created_at", "job_id")).alias("latest_job_status"))
    return reduce(lambda a, b: a.join(b, F.lit(True)), [p, e, f, r, j])  # one line each


def health(jobs: DataFrame, runs: DataFrame, quality: DataFrame, now: Column, interval_hours: int = 24) -> DataFrame:
    """Jobs, the scheduler and data quality in one line; ``quality``: quarantined, unmatched, pending, market."""
    c = F.col
    is_ = lambda s: c("status") == s
    scheduled = (c("job_type") == "INCREMENTAL_PERMIT_IMPORT") & F.coalesce(F.get_json_object("metadata", "$.source") == "scheduler", F.lit(False))
    own = jobs.agg(
        F.count_if(is_("PENDING")).alias("pending_jobs"), F.count_if(is_("RUNNING")).alias("running_jobs"),
        F.count_if(is_("RUNNING") & (c("lock_expires_at").isNull() | (c("lock_expires_at") <= now))).alias("expired_leases"), F.max(F.when(scheduled, c("created_at"))).alias("last_scheduled_at"),
    )
    done = runs.agg(F.max(F.when(c("status").isin("SUCCEEDED", "PARTIALLY_SUCCEEDED"), c("completed_at"))).alias("last_completed_at"))
    both = own.join(done, F.lit(True)).join(quality, F.lit(True)).withColumn("next_run_at", c("last_scheduled_at") + F.expr(f"interval {int(interval_hours)} hours"))
    both = both.withColumn("overdue", c("next_run_at").isNull() | (c("next_run_at") <= now))
    bad = c("overdue") | (c("expired_leases") > 0) | (c("quarantined") > 0) | (c("unmatched") > 0) | (c("pending") > 0) | (c("market") > 0)
    return both.withColumn("state", F.when(bad, "attention").otherwise("ready"))


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def review_queue(projects: DataFrame, filter_: str = "pending") -> DataFrame:
    """The reviewers' queue: pending, market, corrected or all; those for the market first, then the least confident."""
    tests = {"pending": F.col("review_status") == "PENDING", "market": F.col("requires_market_review"), "corrected": F.col("review_status") == "CORRECTED", "all": F.lit(True)}
    return projects.filter(F.col("merged_into").isNull() & tests[filter_]).orderBy(F.desc("requires_market_review"), "confidence", F.col("latest_infill_activity_date").desc_nulls_last(), "project_id")


def failures(failed: DataFrame, runs: DataFrame, page_number: int = 1, size: int = 25) -> DataFrame:
    """A page of quarantined rows with their run."""
    return failed.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id").orderBy(F.desc("created_at"), F.desc("failure_id")).offset((page_number - 1) * size).limit(size)


def rules_list(projects: DataFrame, most: int = 100) -> DataFrame:
    """The first projects of the rules page: by review status in declared order, then the least confident, then the latest
    activity; ties by project_id."""
    status = F.array_position(F.array(*[F.lit(s) for s in REVIEW_STATUSES]), F.col("review_status"))
    return projects.filter(F.col("merged_into").isNull()).orderBy(status, "confidence", F.col("latest_infill_activity_date").desc_nulls_last(), "project_id").limit(most)


def detail(projects: DataFrame, events: DataFrame, wanted: list[str]) -> DataFrame:
    """Some projects (at most ``DETAILS``, by project_id) in full: a row for each milestone of each of their events, with
    the project's own columns and the milestone's ``place`` in its timeline (by date, stage, event and milestone). A project
    without events has one row, its place null. Rows stay rows: however many events a project has, none gathers them."""
    if len(wanted) > DETAILS:
        raise ValueError(f"at most {DETAILS} projects at once")
    own = list_items(projects.filter(F.col("project_id").isin(wanted)))
    told = timeline.milestones(assess.complete(events.filter(F.col("project_id").isin(wanted))))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("milestone_date", "stage_rank", "event_id", "milestone"))
    told = told.withColumn("place", place).select("project_id", "place", "event_id", "milestone", F.col("stage").alias("milestone_stage"), "milestone_date", "permit_type", "permit_subtype", F.col("status").alias("permit_status"), F.col("occupancy_date"))
    return own.join(told, "project_id", "left")


EXPLANATION = """struct<summary:string,score:double,factors:array<struct<rule:string,points:double,message:string>>,
  timeline:struct<demolitionToConstructionDays:double,withinConfiguredWindow:boolean>>"""


def explanation(stored: Column, score: Column) -> Column:
    """struct(summary, score, factors, timeline, available) out of stored JSON. What lacks a summary or has a value out of
    bounds (a summary of 1 to 5,000 characters, a whole score from 0 to 100, at most 100 factors of -100 to 100 points with
    a named rule) is not available: a standing sentence, the stored score and no factors take its place."""
    own = F.from_json(stored, EXPLANATION)
    summary, factors = F.trim(own["summary"]), own["factors"]
    fits = lambda text_, most: (F.length(F.trim(text_)) >= 1) & (F.length(F.trim(text_)) <= most)
    sound = lambda f: fits(f["rule"], 200) & f["points"].between(-100, 100) & (f["message"].isNull() | fits(f["message"], 1_000))
    days = own["timeline"]["demolitionToConstructionDays"]
    available = F.coalesce(
        fits(summary, 5_000) & (own["score"].isNull() | (own["score"].between(0, 100) & (own["score"] == F.floor(own["score"])))) & (days.isNull() | (days == F.floor(days)))
        & (factors.isNull() | ((F.size(factors) <= 100) & F.forall(factors, lambda f: F.coalesce(sound(f), F.lit(False))))), F.lit(False),
    )
    factor = "array<struct<rule:string,points:double,message:string>>"
    tidy = F.transform(F.coalesce(factors, F.array().cast(factor)), lambda f: F.struct(F.trim(f["rule"]).alias("rule"), f["points"].alias("points"), F.trim(f["message"]).alias("message")))
    told = F.when(own["timeline"].isNotNull(), F.struct(days.cast("long").alias("days"), own["timeline"]["withinConfiguredWindow"].alias("within_window")))
    return F.struct(
        F.when(available, summary).otherwise(NO_EXPLANATION).alias("summary"), F.when(available, F.coalesce(own["score"].cast("int"), score)).otherwise(score).alias("score"),
        F.when(available, tidy).otherwise(F.array().cast(factor)).alias("factors"), F.when(available, told).alias("timeline"), available.alias("available"),
    )

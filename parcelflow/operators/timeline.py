"""Milestones and stages of permits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STAGES
from ..functions import dates, text

_CANCELLED = r"\b(?:cancelled|canceled|withdrawn|void|voided)\b"


def stage_rank(stage: Column) -> Column:
    """0 for the first stage, in declared order."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1


def _issued(words: Column) -> Column:
    cases = [
        (words.rlike(r"\binspection\b"), "INSPECTION", "INSPECTION"),
        (words.rlike(r"\b(?:construction started|under construction|work started)\b"), "CONSTRUCTION", "CONSTRUCTION"),
        (words.rlike(r"\b(?:demolition|demolish)\b"), "DEMOLITION", "DEMOLITION"),
        (F.col("dataset") == "development", "DEVELOPMENT_PERMIT", "DEVELOPMENT_PERMIT"),
        (F.col("dataset") == "building", "BUILDING_PERMIT", "BUILDING_PERMIT"),
        (words.rlike(r"\bdevelopment\b"), "DEVELOPMENT_PERMIT", "DEVELOPMENT_PERMIT"),
        (words.rlike(r"\b(?:building|new house|new dwelling|residential construction)\b"), "BUILDING_PERMIT", "BUILDING_PERMIT"),
    ]
    made = lambda kind, stage: F.struct(F.lit(kind).alias("type"), F.lit(stage).alias("stage"), F.col("issue_date").alias("date"))
    out = made("OTHER", "DISCOVERED")
    for test, kind, stage in reversed(cases):
        out = F.when(test, made(kind, stage)).otherwise(out)
    return out


def found(columns: list[str]) -> Column:
    """The milestones of a permit, up to three, as an array of (type, stage, date). Expects the permit's texts and dates,
    observed_at (first seen), event_date and, where ``columns`` has it, imported_at."""
    c = F.col
    words = text.lowered(c("permit_type"), c("permit_subtype"), c("status"), c("description"))
    imported = c("imported_at") if "imported_at" in columns else F.lit(None).cast("timestamp")
    observed = F.coalesce(dates.local_date(c("observed_at")), c("event_date"), dates.local_date(imported))
    one = lambda kind, stage, date: F.struct(F.lit(kind).alias("type"), stage.alias("stage"), date.alias("date"))
    parts = F.array(
        F.when(c("application_date").isNotNull(), one("APPLICATION", F.when(words.rlike(r"\bdevelopment\b"), "DEVELOPMENT_APPLICATION").otherwise("DISCOVERED"), c("application_date"))),
        F.when(c("issue_date").isNotNull(), _issued(words)).when(c("application_date").isNull() & c("occupancy_date").isNull() & observed.isNotNull(), one("OBSERVED", F.lit("DISCOVERED"), observed)),
        F.when(c("occupancy_date").isNotNull(), one("OCCUPANCY", F.lit("COMPLETE"), c("occupancy_date"))),
    )
    return F.filter(parts, lambda m: m.isNotNull())


def milestones(permits: DataFrame) -> DataFrame:
    """A row for each milestone: the permit's columns, milestone, stage, milestone_date and stage_rank."""
    out = permits.withColumn("_m", F.explode(found(permits.columns))).select("*", F.col("_m.type").alias("milestone"), F.col("_m.stage").alias("stage"), F.col("_m.date").alias("milestone_date")).drop("_m")
    return out.withColumn("stage_rank", stage_rank(F.col("stage")))


def ordered(milestone_rows: DataFrame) -> DataFrame:
    return milestone_rows.orderBy("milestone_date", "stage_rank", "event_id", "milestone")


def _cancels() -> Column:
    status = F.lower(text.strip(F.col("status")))
    return F.coalesce((status != "") & status.rlike(_CANCELLED), F.lit(False))


def _highest() -> Column:
    return F.array_max(F.transform("_milestones", lambda m: stage_rank(m["stage"])))


def told(permits: DataFrame) -> DataFrame:
    """``permits`` with what their milestones tell, in columns of fixed width, which windows sort in place of arrays and texts:
    the rank of the highest stage, the first and latest dates, and whether the status cancels."""
    on = lambda pick: pick(F.transform("_milestones", lambda m: m["date"]))
    own = permits.withColumn("_milestones", found(permits.columns))
    return own.withColumns({"_highest": _highest(), "_first": on(F.array_min), "_latest": on(F.array_max), "_cancels": _cancels()}).drop("_milestones")


def told_aggregates(counts: Column) -> list[Column]:
    """``stage_aggregates`` over permits that have the columns of ``told``."""
    return _aggregates(counts, F.col("_highest"), F.col("_cancels"))


def stage_aggregates(counts: Column) -> list[Column]:
    """Aggregates that ``stage_of`` reads, over the permits for which ``counts`` holds; they have ``_milestones``."""
    return _aggregates(counts, _highest(), _cancels())


def _aggregates(counts: Column, highest: Column, cancels: Column) -> list[Column]:
    return [
        F.bool_or(counts & F.col("occupancy_date").isNotNull()).alias("_occupied"), F.bool_and(F.when(counts, cancels)).alias("_cancelled"),
        F.max(F.when(counts, highest)).alias("_rank"),
    ]


def stage_of() -> Column:
    """COMPLETE by any occupancy; CANCELLED if every permit has a status and all are cancelled; else the highest stage of
    the milestones, or the first."""
    names = F.array(*[F.lit(s) for s in STAGES])
    return F.when(F.col("_occupied"), "COMPLETE").when(F.col("_cancelled"), "CANCELLED").otherwise(F.element_at(names, (F.coalesce("_rank", F.lit(0)) + 1).cast("int")))


def project_stages(permits: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, stage), by one partial aggregate."""
    return permits.withColumn("_milestones", found(permits.columns)).groupBy(key).agg(*stage_aggregates(F.lit(True))).select(key, stage_of().alias("stage"))

"""Filters of the project lists: checked values on the driver, columns in the plan."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import date
from functools import reduce
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, PUBLIC_CATEGORIES, REVIEW_STATUSES, STAGES

# Names of sorts and of query parameters.
SORT_COLUMNS = {
    "latestEventDate": "latest_infill_activity_date", "earliestEventDate": "infill_start_date", "confidence": "confidence", "value": "value", "units": "units",
    "address": "street", "neighbourhood": "neighbourhood_name", "category": "effective_category", "stage": "effective_stage", "reviewStatus": "review_status",
}
_ORDINALS = {"category": CATEGORIES, "stage": STAGES, "reviewStatus": REVIEW_STATUSES}
_PARAMETERS = {
    "neighbourhoods": "neighbourhood", "categories": "category", "stages": "stage", "review_statuses": "reviewStatus", "min_confidence": "minConfidence",
    "min_value": "minValue", "max_value": "maxValue", "min_units": "minUnits", "max_units": "maxUnits", "page_size": "pageSize", "start": "from", "end": "to",
}
# end of the fixed values


class FilterError(ValueError):
    """A filter that cannot be used; ``field`` names it."""

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field


@dataclass(frozen=True)
class ProjectFilters:
    view: str = "split"
    scope: str = "citywide"
    q: str | None = None
    neighbourhoods: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    review_statuses: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    min_confidence: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    min_units: int | None = None
    max_units: int | None = None
    sort: str = "latestEventDate"
    direction: str = "desc"
    page: int = 1
    page_size: int = 25

    def __post_init__(self):
        one_of = lambda name, allowed: None if getattr(self, name) in allowed else _refuse(name, "is not an allowed value")
        one_of("view", ("list", "map", "split"))
        one_of("scope", ("citywide", "core"))
        one_of("sort", SORT_COLUMNS)
        one_of("direction", ("asc", "desc"))
        for name, allowed in (("categories", PUBLIC_CATEGORIES), ("stages", STAGES), ("review_statuses", ["PENDING", "CONFIRMED", "CORRECTED"])):
            if set(getattr(self, name)) - set(allowed):
                _refuse(name, "has an unknown value")
        if len(self.neighbourhoods) > 50 or any(not 1 <= len(n) <= 100 for n in self.neighbourhoods):
            _refuse("neighbourhoods", "at most 50 names of 1 to 100 characters")
        if self.q is not None and len(self.q) > 200:
            _refuse("q", "at most 200 characters")
        for name in ("start", "end"):
            value = getattr(self, name)
            if value is not None and not _civil(value):
                _refuse(name, "is no calendar date (YYYY-MM-DD)")
        for name, low, high in (("min_confidence", 0, 100), ("min_value", 0, 999_999_999_999.99), ("max_value", 0, 999_999_999_999.99), ("min_units", -100_000, 100_000), ("max_units", -100_000, 100_000), ("page", 1, 10_000), ("page_size", 1, 100)):
            value = getattr(self, name)
            if value is not None and not (math.isfinite(value) and low <= value <= high):
                _refuse(name, f"must be from {low} to {high}")
        for low, high in (("start", "end"), ("min_value", "max_value"), ("min_units", "max_units")):
            a, b = getattr(self, low), getattr(self, high)
            if a is not None and b is not None and a > b:
                _refuse(high, "must not be below the lower bound")


def _refuse(field: str, message: str):
    raise FilterError(field, message)


def _civil(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def parse(params: Mapping[str, str | list[str]]) -> ProjectFilters:
    """Filters out of query parameters. Lists are split at commas and made distinct in order; of a single value that
    holds commas the first part counts; empty parts are none."""
    found = {}
    for f in fields(ProjectFilters):
        raw = params.get(_PARAMETERS.get(f.name, f.name), params.get(f.name))
        parts = [p.strip() for v in ([raw] if isinstance(raw, str) else raw or []) for p in v.split(",")]
        parts = list(dict.fromkeys(p for p in parts if p))
        if not parts:
            continue
        if f.name in ("neighbourhoods", "categories", "stages", "review_statuses"):
            found[f.name] = tuple(parts)
        elif f.name in ("min_confidence", "min_units", "max_units", "page", "page_size", "min_value", "max_value"):
            try:
                number = float(parts[0])
            except ValueError:
                _refuse(f.name, "is no number")
            if "value" not in f.name and number != int(number):
                _refuse(f.name, "must be a whole number")
            found[f.name] = number if "value" in f.name else int(number)
        else:
            found[f.name] = parts[0]
    return ProjectFilters(**found)


def to_query(filters: ProjectFilters) -> str:
    """The query string that parses to these filters; defaults are left out."""
    default, pairs = ProjectFilters(), []
    for f in fields(filters):
        value = getattr(filters, f.name)
        if value != getattr(default, f.name):
            pairs.append((_PARAMETERS.get(f.name, f.name), ",".join(value) if isinstance(value, tuple) else str(value)))
    return urlencode(pairs)


def is_public() -> Column:
    """Not merged away and of a relevant category."""
    return F.col("merged_into").isNull() & (F.col("effective_category") != "NOT_RELEVANT")


def predicate(filters: ProjectFilters) -> Column:
    """All but the text filter, as one conjunction; every part can reach a scan."""
    c = F.col
    tests = [is_public()]
    if filters.scope == "core":
        tests.append(c("area_class") == "CORE")
    for values, column in ((filters.neighbourhoods, "neighbourhood_id"), (filters.categories, "effective_category"), (filters.stages, "effective_stage"), (filters.review_statuses, "review_status")):
        if values:
            tests.append(c(column).isin(*values))
    for value, column, low in (
        (filters.min_confidence, "confidence", True), (filters.start and date.fromisoformat(filters.start), "latest_infill_activity_date", True), (filters.end and date.fromisoformat(filters.end), "latest_infill_activity_date", False),
        (filters.min_value, "value", True), (filters.max_value, "value", False), (filters.min_units, "units", True), (filters.max_units, "units", False),
    ):
        if value is not None:
            tests.append(c(column) >= F.lit(value) if low else c(column) <= F.lit(value))
    return reduce(lambda a, b: a & b, tests)


def apply(projects: DataFrame, filters: ProjectFilters, permits: DataFrame | None = None) -> DataFrame:
    """The projects that pass. The text is sought, without case, in title, street, or any permit number (permits with
    project_id and permit_number): those projects are made distinct before the join."""
    own = projects.filter(predicate(filters))
    if not filters.q:
        return own
    sought = filters.q.lower()
    has = lambda column: F.coalesce(F.lower(column).contains(sought), F.lit(False))
    hit = has(F.col("title")) | has(F.col("street"))
    if permits is None:
        return own.filter(hit)
    numbered = permits.filter(has(F.col("permit_number"))).select("project_id").distinct().withColumn("_numbered", F.lit(True))
    return own.join(numbered, "project_id", "left").filter(hit | F.col("_numbered").isNotNull()).drop("_numbered")


def apply_found(projects: DataFrame, filters: ProjectFilters, found: DataFrame) -> DataFrame:
    """The projects that pass, where ``found`` has, as ``key``, the ids of those that the text was found in (see
    ``gramindex.search``): no text is read again."""
    return projects.filter(predicate(filters)).join(found.withColumnRenamed("key", "project_id"), "project_id", "left_semi")


def order_by(filters: ProjectFilters) -> list[Column]:
    """The sort columns; enumerations go by declared order, dates, values and units have nulls last, ties go by id."""
    column = F.col(SORT_COLUMNS[filters.sort])
    if filters.sort in _ORDINALS:
        column = F.array_position(F.array(*[F.lit(v) for v in _ORDINALS[filters.sort]]), column)
    if filters.sort in ("address", "neighbourhood"):
        column = F.collate(column, "UNICODE")
    first = column.asc_nulls_last() if filters.direction == "asc" else column.desc_nulls_last()
    return [first, F.col("project_id").asc()]


# ------------------------------------------------- requests of administrators


@dataclass(frozen=True)
class ImportRequest:
    datasets: tuple[str, ...]
    mode: str = "FULL"
    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        if not self.datasets or len(set(self.datasets)) != len(self.datasets) or set(self.datasets) - {"development", "building"}:
            _refuse("datasets", "development and building, each at most once")
        if self.mode not in ("FULL", "INCREMENTAL", "BACKFILL"):
            _refuse("mode", "is not an allowed value")
        if (self.mode == "BACKFILL") != (self.start is not None and self.end is not None):
            _refuse("mode", "a backfill needs both dates, others take none")
        if self.mode == "BACKFILL":
            for name in ("start", "end"):
                value = getattr(self, name)
                if not _civil(value) or not 2000 <= int(value[:4]) <= 2100:
                    _refuse(name, "must be a real date from 2000 to 2100")
            days = (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days + 1
            if not 1 <= days <= 366:
                _refuse("end", "the range must have 1 to 366 days, both ends counted")

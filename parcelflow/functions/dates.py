"""Civil dates and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Edmonton"
PERIODS = ("7", "30", "90", "180", "365", "730", "all")


def local_date(instant: Column, zone: str = ZONE) -> Column:
    """The civil date on which an instant falls locally."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def window_start(through: Column, days: int | None) -> Column:
    """First day of an inclusive window of so many days; null (unbounded) without."""
    return F.lit(None).cast("date") if days is None else F.date_sub(through, days - 1)


def in_range(date: Column, start: Column, through: Column) -> Column:
    return F.coalesce((start.isNull() | (date >= start)) & (date <= through), F.lit(False))


def cohort_start(as_of: Column) -> Column:
    """Five years back, from 2022 on; a 29 February that does not exist becomes 1 March."""
    back = F.add_months(as_of, -60)
    leap = (F.month(as_of) == 2) & (F.dayofmonth(as_of) == 29) & (F.dayofmonth(back) != 29)
    return F.greatest(F.when(leap, F.date_add(back, 1)).otherwise(back), F.to_date(F.lit("2022-01-01")))


def first_present(*dates: Column) -> Column:
    return F.coalesce(*dates)


def event_time(issue: Column, application: Column, event: Column, occupancy: Column) -> Column:
    """When an event counts for demolition-to-construction days."""
    return F.coalesce(issue, application, event, occupancy)


def project_event_date(issue: Column, application: Column, occupancy: Column, created: Column, event: Column, imported: Column) -> Column:
    """The date that orders an event within its project; observation times only where no civic date is known."""
    return F.coalesce(issue, application, occupancy, local_date(created), event, local_date(imported))


def source_span(*dates: Column) -> tuple[Column, Column]:
    """First and last of the known dates."""
    return F.least(*dates), F.greatest(*dates)

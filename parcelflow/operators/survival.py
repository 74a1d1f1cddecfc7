"""Time to occupancy: right-censored product-limit curves, their benchmarks, and estimates of open permits."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources import snapshot

MAX_DAYS = 730
MIN_COHORT, MIN_EVENTS = 50, 30
BASELINE_DAYS = 548
PORTFOLIO, BASELINE = "PORTFOLIO", "BASELINE"
#: Categories with benchmarks of their own; both kinds of detached houses share one.
GROUPS = {
    "PROBABLE_NEW_DETACHED_INFILL": "DETACHED", "PROBABLE_NEW_DETACHED_INFILL_FOR_RESALE": "DETACHED", "PROBABLE_SEMI_DETACHED_INFILL": "PROBABLE_SEMI_DETACHED_INFILL",
    "PROBABLE_DUPLEX": "PROBABLE_DUPLEX", "PROBABLE_ROW_HOUSING": "PROBABLE_ROW_HOUSING", "PROBABLE_GARDEN_SUITE": "PROBABLE_GARDEN_SUITE",
}


def group_of(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair]), category)


def observations(permits: DataFrame, as_of: Column, issue: str = "issue_date", occupied: str = "occupancy_date", max_days: int = MAX_DAYS) -> DataFrame:
    """``permits`` with ``days`` and ``occupied`` (the outcome was seen). Permits issued after ``as_of``, outcomes after
    it, and outcomes on or before the day of issue are left out; what lasts longer than ``max_days`` is censored there."""
    start, end = F.to_date(issue), F.to_date(occupied)
    elapsed, lasted = F.datediff(as_of, start), F.datediff(end, start)
    own = permits.withColumns({"_elapsed": elapsed, "_lasted": lasted, "_open": end.isNull(), "_late": F.coalesce(end > as_of, F.lit(False))})
    own = own.filter((F.col("_elapsed") >= 0) & (F.col("_open") | (~F.col("_late") & (F.col("_lasted") > 0))))
    seen = ~F.col("_open") & (F.col("_lasted") <= max_days)
    days = F.when(F.col("_open"), F.least(F.col("_elapsed"), F.lit(max_days))).otherwise(F.least(F.col("_lasted"), F.lit(max_days)))
    return own.withColumns({"occupied": seen, "days": days}).drop("_elapsed", "_lasted", "_open", "_late")


def curve(observed: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., days, events, censored, at_risk, survival): counted by day first, so that the windows see
    ``max_days`` rows of a scope at most, however many permits there are."""
    return _product_limit(by_day(observed, scope), scope)


def by_day(observed: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., days, events, censored)."""
    return observed.groupBy(*scope, "days").agg(F.count_if("occupied").alias("events"), F.count_if(~F.col("occupied")).alias("censored"))


def _product_limit(counted: DataFrame, scope: list[str]) -> DataFrame:
    whole = Window.partitionBy(*scope)
    ordered = whole.orderBy("days")
    leaving = F.col("events") + F.col("censored")
    risk = F.sum(leaving).over(whole) - F.sum(leaving).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + leaving
    own = counted.withColumn("at_risk", risk)
    return own.withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def benchmarks(observed: DataFrame, scope: list[str], min_cohort: int = MIN_COHORT, min_events: int = MIN_EVENTS) -> DataFrame:
    """A row for each scope: cohort_size, occupancy_count, censored_permits, p25, median and p75 days, and whether it is
    adequate. Quantiles are the first days with survival at 0.75, 0.5 and 0.25 or below; null where never reached."""
    return _benchmarks(curve(observed, scope), scope, min_cohort, min_events)


def _benchmarks(curves: DataFrame, scope: list[str], min_cohort: int, min_events: int) -> DataFrame:
    first = lambda level: F.min(F.when((F.col("events") > 0) & (F.col("survival") <= level), F.col("days")))
    own = curves.groupBy(*scope).agg(
        F.sum(F.col("events") + F.col("censored")).alias("cohort_size"), F.sum("events").alias("occupancy_count"), F.sum("censored").alias("censored_permits"),
        first(0.75).alias("p25_days"), first(0.5).alias("median_days"), first(0.25).alias("p75_days"),
    )
    return own.withColumn("adequate", (F.col("cohort_size") >= min_cohort) & (F.col("occupancy_count") >= min_events))


def benchmark_set(observed: DataFrame, group: str, min_cohort: int = MIN_COHORT, min_events: int = MIN_EVENTS) -> DataFrame:
    """Benchmarks of the portfolio and of each group, in one pass: observations are counted by group and day, and only
    these counts stand in two scopes."""
    both = F.explode(F.array(F.lit(PORTFOLIO), F.col(group)))
    counts = by_day(observed, [group]).select(both.alias("scope"), "days", "events", "censored").filter(F.col("scope").isNotNull())
    counts = counts.groupBy("scope", "days").agg(F.sum("events").alias("events"), F.sum("censored").alias("censored"))
    return _benchmarks(_product_limit(counts, ["scope"]), ["scope"], min_cohort, min_events)


def with_fallback(rows: DataFrame, group: str, benchmark_rows: DataFrame) -> DataFrame:
    """``rows`` with the benchmark of their group if that is adequate, else the portfolio's if that is, else the planning
    baseline. Benchmarks without a median are none. A row without a group gets the baseline."""
    fields = ["scope", "cohort_size", "occupancy_count", "p25_days", "median_days", "p75_days"]
    good = benchmark_rows.filter(F.col("adequate") & F.col("median_days").isNotNull())
    by_group = good.select(F.struct(*fields).alias("_own"), F.col("scope").alias("_group"))
    overall = good.filter(F.col("scope") == PORTFOLIO).select(F.struct(*fields).alias("_all"))
    own = rows.join(by_group, F.col(group) == F.col("_group"), "left").drop("_group").join(F.broadcast(overall), F.lit(True), "left")  # one row at most
    null = F.lit(None)
    base = F.struct(F.lit(BASELINE).alias("scope"), F.lit(0).cast("long").alias("cohort_size"), F.lit(0).cast("long").alias("occupancy_count"), null.cast("int").alias("p25_days"), F.lit(BASELINE_DAYS).alias("median_days"), null.cast("int").alias("p75_days"))
    chosen = F.when(F.col(group).isNull(), base).otherwise(F.coalesce("_own", "_all", base))
    return own.withColumn("_b", chosen).select(*rows.columns, *[F.col(f"_b.{f}").alias(f) for f in fields])


def timing(rows: DataFrame, as_of: Column, issue: str = "issue_date", max_days: int = MAX_DAYS) -> DataFrame:
    """``rows`` (with median_days and scope) with elapsed, remaining and excess days, progress, and the typical date.
    Permits issued after ``as_of`` have none and are left out."""
    elapsed = F.datediff(as_of, F.to_date(issue))
    own = rows.withColumn("elapsed_days", elapsed).filter(F.col("elapsed_days") >= 0)
    e, m = F.col("elapsed_days"), F.col("median_days")
    return own.withColumns({
        "comparison_elapsed_days": F.least(e, F.lit(max_days)),
        "typical_date": F.date_add(F.to_date(issue), m.cast("int")),
        "days_remaining": F.greatest(F.lit(0), m - e),
        "days_beyond_typical": F.greatest(F.lit(0), e - m),
        "days_from_typical": e - m,
        "progress": F.least(e, F.lit(max_days)) / F.lit(max_days),
        "beyond_window": e > max_days,
        "basis": F.when(F.col("scope") == BASELINE, "PLANNING_BASELINE").otherwise("HISTORICAL_KAPLAN_MEIER"),
    })


def pending_anchors(assessed: DataFrame, as_of: Column, key: str = "project_id") -> DataFrame:
    """(key, event_id, issue_date): the earliest principal residential building permit of each project none of whose
    permits has an occupancy date; ties by event_id."""
    fit = (F.col("dataset") == "building") & (F.col("issue_date") <= as_of) & (F.col("role") == "PRINCIPAL_RESIDENTIAL")
    own = assessed.groupBy(key).agg(F.bool_or(F.col("occupancy_date").isNotNull()).alias("_occupied"), F.min(F.when(fit, F.struct("issue_date", "event_id"))).alias("_first"))
    return own.filter(~F.col("_occupied") & F.col("_first").isNotNull()).select(key, F.col("_first.event_id").alias("event_id"), F.col("_first.issue_date").alias("issue_date"))


class BenchmarkCache:
    """Benchmarks by as-of date for so many seconds: a table with a row for each scope, computed once and checkpointed."""

    def __init__(self, make: Callable[[date], DataFrame], seconds: float = 6 * 3600, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self._kept: dict[date, tuple[float, DataFrame]] = {}

    def get(self, as_of: date) -> DataFrame:
        now = self.clock()
        self._kept = {d: kept for d, kept in self._kept.items() if now - kept[0] < self.seconds}
        if as_of not in self._kept:
            self._kept[as_of] = now, checkpointed(self.make(as_of))
        return self._kept[as_of][1]


class BenchmarkStore:
    """Benchmarks in a shared folder: a published table for each as-of date and policy, which any session reads while it is
    younger than so many seconds. Of two sessions that make one at a time, the later reads what the first published."""

    def __init__(self, spark: SparkSession, root: str, seconds: float = 6 * 3600, now: Callable[[], float] = time.time):
        self.spark, self.root, self.seconds, self.now = spark, root, seconds, now

    def path(self, as_of: date, policy: Mapping[str, object]) -> str:
        """The folder of a date and a policy: everything that the benchmarks depend on besides the permits."""
        digest = hashlib.sha256(json.dumps(dict(policy), sort_keys=True, default=str).encode()).hexdigest()
        return f"{self.root}/{as_of.isoformat()}-{digest[:32]}"

    def get(self, as_of: date, policy: Mapping[str, object], make: Callable[[], DataFrame]) -> DataFrame:
        root = self.path(as_of, policy)
        kept = snapshot.last_checkpoint(self.spark, root)
        if kept is None or self.now() - float(kept.revision) >= self.seconds:
            made = make()
            mark = snapshot.Checkpoint("benchmarks", root.rsplit("/", 1)[1], repr(self.now()), made.schema.simpleString(), 0)
            try:
                snapshot.publish(made, root, mark)
            except snapshot.AlreadyPublished:
                pass  # another session's
        return snapshot.published(self.spark, root)

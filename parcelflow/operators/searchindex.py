"""An inverted index of saved searches, by what they ask for.

Every search is entered under one of its criteria, its *lead*: the one that the fewest projects meet, as counts of the
projects by value tell. A selection has an entry for each chosen value, a range one for each *interval* that it touches:
intervals are cut so that projects spread evenly over them. A project looks up its own values and intervals, eight at
most, and what it finds is held against the other criteria. So a search of ranges alone is found by its ranges, and only
one that asks for nothing is found by all projects, as it must be. Entries are copied to ``DEALS`` places each and projects
are dealt to them, so that a value that many projects share is no single key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges
from ..session import checkpointed
from . import alerts

INTERVALS = 64
DEALS = 16
#: criterion: column of a project's side, lower and upper bound of a search
RANGES = {"value": ("p_value", "min_value", "max_value"), "units": ("p_units", "min_units", "max_units"), "confidence": ("p_confidence", "min_confidence", None)}


def cuts(projects: DataFrame, intervals: int = INTERVALS) -> dict[str, list[float]]:
    return ranges.cuts(projects, {name: F.col(mine).cast("double") for name, (mine, _, _) in RANGES.items()}, intervals)


def _own_keys(points: dict[str, list[float]]) -> Column:
    """What a project looks up: (criterion, key) of its values and intervals, and of nothing."""
    entry = lambda name, key: F.struct(F.lit(name).alias("criterion"), key.cast("string").alias("key"))
    named = lambda name, values: F.transform(values, lambda v: entry(name, v))
    chosen = [named(k, F.array_distinct(F.array_compact(F.col(mine)))) for k, mine in alerts.SELECTIONS.items()]
    within = [F.array(entry(name, ranges.interval(F.col(mine).cast("double"), points[name]))) for name, (mine, _, _) in RANGES.items()]
    return F.filter(F.concat(*chosen, *within, F.array(entry("none", F.lit("")))), lambda e: e["key"].isNotNull())


def _entries(points: dict[str, list[float]]) -> Column:
    """The criteria of a search, each with its keys; the criterion ``none`` where there is no other."""
    made = lambda name, keys: F.struct(F.lit(name).alias("criterion"), keys.alias("keys"))
    chosen = [F.when(F.size(k) > 0, made(k, F.col(k))) for k in alerts.SELECTIONS]
    within = []
    for name, (_, low, high) in RANGES.items():
        first = F.coalesce(ranges.interval(F.col(low).cast("double"), points[name]), F.lit(0))
        last = F.coalesce(ranges.interval(F.col(high).cast("double"), points[name]), F.lit(len(points[name]))) if high else F.lit(len(points[name]))
        asked = F.col(low).isNotNull() | F.col(high).isNotNull() if high else F.col(low).isNotNull()
        keys = F.when(first <= last, F.transform(F.sequence(first, last), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
        within.append(F.when(asked, made(name, keys)))
    own = F.array_compact(F.array(*chosen, *within))
    return F.when(F.size(own) > 0, own).otherwise(F.array(made("none", F.array(F.lit("")))))


def build(searches: DataFrame, sides: DataFrame, points: dict[str, list[float]]) -> DataFrame:
    """The index: a row (criterion, key, and the search) for each key of each search's lead. ``sides`` are the projects as
    ``alerts.sides`` has them, searches as ``alerts.sought``; ties go to the criterion's name."""
    met = sides.select(F.inline(_own_keys(points))).groupBy("criterion", "key").agg(F.count("*").alias("n"))
    entries = searches.select("search_id", F.explode(_entries(points)).alias("e")).select("search_id", "e.criterion", F.explode_outer("e.keys").alias("key"))
    weighed = entries.join(met, ["criterion", "key"], "left").groupBy("search_id", "criterion").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    lead = weighed.groupBy("search_id").agg(F.min_by("criterion", F.struct("n", "criterion")).alias("criterion"))
    return entries.join(lead, ["search_id", "criterion"]).filter("key is not null").join(searches, "search_id")


def match(projects: DataFrame, searches: DataFrame, intervals: int = INTERVALS) -> DataFrame:
    """(search_id, user_id, project_id) of the pairs that match, each once; searches that are not active take no part."""
    own = checkpointed(alerts.sides(projects))
    points = cuts(own, intervals)
    asked = checkpointed(alerts.sought(searches.filter(F.coalesce("active", F.lit(True)))))
    index = build(asked, own, points).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    looked = own.withColumn("deal", F.pmod(F.xxhash64("project_id"), F.lit(DEALS)).cast("int")).select("*", F.inline(_own_keys(points)))
    c = F.col
    # a project may meet a selection by both its names: the first of them counts
    first = [F.when(c("criterion") == k, c("key") == F.element_at(F.array_intersect(mine, k), 1)) for k, mine in alerts.SELECTIONS.items()]
    once = F.coalesce(*first, F.lit(True))
    good = reduce(lambda a, b: a & b, [ok for code, ok in alerts.checks() if code != "inactive"])
    found = looked.join(index, ["criterion", "key", "deal"]).filter(once & F.coalesce(good, F.lit(False)))
    return found.select("search_id", "user_id", "project_id")

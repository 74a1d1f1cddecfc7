"""Episodes: gap sessions of interval events, the latest of each key, and earlier-partner searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges
from ..session import checkpointed

#: Time slices that a key's events are cut to where keys may be hot.
SLICES = 64


def sessions(events: DataFrame, key: str | list[str], start: str, end: str, gap: Column, order: list[str]) -> DataFrame:
    """``events`` with ``episode`` (1, 2, ...): a new one begins where an event starts more than ``gap`` after the
    latest end so far. One shuffle by key; ties follow ``order``."""
    keys = [key] if isinstance(key, str) else key
    by = Window.partitionBy(*keys).orderBy(start, *order)
    latest = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_new", (latest.isNull() | (F.col(start) > latest + gap)).cast("int")).withColumn("episode", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _sliced(events: DataFrame, start: str, slices: int, last: bool = False) -> DataFrame:
    """``events`` with ``_slice``: which of at most ``slices`` intervals of time an event starts in. Events without a start
    come before all others, or ``last``."""
    micros = F.unix_micros(F.col(start).cast("timestamp"))
    points = ranges.cuts(events, {"start": micros}, slices)["start"]
    return events.withColumn("_slice", F.coalesce(ranges.interval(micros, points), F.lit(slices if last else -1)))


def _carried(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, _slice, name): an aggregate of each slice's rows, carried over the slices before it; null for the first.
    ``value`` is an aggregate that can be taken again of its own results (max or sum)."""
    per_slice = rows.groupBy(*keys, "_slice").agg(value.alias(name))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    again = F.max(name) if value._jc.toString().lower().startswith("max") else F.sum(name)
    return per_slice.withColumn(name, again.over(before))


def sliced_sessions(events: DataFrame, key: str | list[str], start: str, end: str, gap: Column, order: list[str | Column], slices: int = SLICES, last: bool = False) -> DataFrame:
    """``sessions`` in two levels, for keys that may hold any share of the events: a key's events are cut to slices of time
    and dealt by key and slice. Within a slice the latest end so far is a running maximum; between slices it is one of the
    slices' own maxima, of which a key has ``slices`` at most. Episodes are numbered in the same way. ``_slice`` stays.
    """
    keys = [key] if isinstance(key, str) else key
    own = _sliced(events, start, slices, last).repartition(*keys, "_slice")
    by = Window.partitionBy(*keys, "_slice").orderBy(start, *order)
    earlier = _carried(own, keys, F.max(end), "_top")
    latest = F.greatest(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"))
    joined = _same(own, earlier, [*keys, "_slice"]).withColumn("_latest", latest)
    flagged = joined.withColumn("_new", (F.col("_latest").isNull() | (F.col(start) > F.col("_latest") + gap)).cast("int")).drop("_top", "_latest")
    begun = _carried(flagged, keys, F.sum("_new"), "_begun")
    count = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_begun", F.lit(0))
    return _same(flagged, begun, [*keys, "_slice"]).withColumn("episode", count).drop("_new", "_begun")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join by keys that may be null, which are equal then."""
    named = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r{k}"]) for k in keys]
    return left.join(named, on, "left").drop(*[f"_r{k}" for k in keys])


def mark_episode(assessed: DataFrame, gap_days: int = 548, key: str = "project_id") -> DataFrame:
    """All events, with ``in_episode``: whether they belong to their key's latest episode, its episode_start and
    episode_end (null if undated), and the ``position`` within it.

    Property-only and excluded events never count. The latest session is cut at ``gap_days`` before its end by the
    events' ordering dates. A key without any dated event keeps its undated ones. Rows dealt by ``key`` before are not
    dealt again: every window here is of the key or of a part of it.
    """
    c = F.col
    gap = F.expr(f"interval {int(gap_days)} days")
    eligible, dated = ~c("role").isin("PROPERTY_ONLY", "EXCLUDED"), c("ordering_date").isNotNull()
    own = assessed.withColumns({
        "_start": F.coalesce(c("source_start").cast("timestamp"), c("ordering_date")), "_end": F.coalesce(c("source_end").cast("timestamp"), c("ordering_date")),
        "_kind": F.when(~eligible, 2).when(dated, 0).otherwise(1),
    })
    by = Window.partitionBy(key, "_kind").orderBy("_start", F.coalesce("event_date", F.to_date("_start")), "event_id")
    before = F.max("_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_new", ((c("_kind") == 0) & (before.isNull() | (c("_start") > before + gap))).cast("int"))
    own = own.withColumn("episode", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(key)
    own = own.withColumn("_last", F.max(F.when(c("_kind") == 0, c("episode"))).over(whole))
    own = own.withColumn("_candidate", F.when(c("_last").isNotNull(), (c("_kind") == 0) & (c("episode") == c("_last"))).otherwise(c("_kind") == 1))
    own = own.withColumn("_episode_end", F.max(F.when(c("_candidate"), c("_end"))).over(whole))
    own = own.withColumn("in_episode", c("_candidate") & F.coalesce((c("_kind") != 0) | (c("ordering_date") >= c("_episode_end") - gap), F.lit(False)))
    own = own.withColumns({
        "episode_start": F.min(F.when(c("in_episode"), c("source_start"))).over(whole), "episode_end": F.max(F.when(c("in_episode"), c("source_end"))).over(whole),
        "position": F.row_number().over(Window.partitionBy(key, "in_episode").orderBy(F.asc_nulls_last("_start"), F.asc_nulls_last("event_date"), "event_id")),
    })
    return own.drop("_start", "_end", "_kind", "_new", "_last", "_candidate", "_episode_end")


def latest_episode(assessed: DataFrame, gap_days: int = 548, key: str = "project_id", slices: int = 0) -> DataFrame:
    """The events of each key's latest episode alone. With ``slices``, keys may hold any share of the events: they are dealt
    by key and slice of time, and what a key's slices tell of each other is joined to them. The events that count are then
    computed once and written to the shared folder with all their columns, so that a caller should keep those it needs."""
    return _sliced_episode(assessed, gap_days, key, slices) if slices else mark_episode(assessed, gap_days, key).filter("in_episode").drop("in_episode")


def _sliced_episode(assessed: DataFrame, gap_days: int, key: str, slices: int) -> DataFrame:
    c, gap = F.col, F.expr(f"interval {int(gap_days)} days")
    own = checkpointed(assessed.filter(~c("role").isin("PROPERTY_ONLY", "EXCLUDED"))).withColumns({
        "_start": F.coalesce(c("source_start").cast("timestamp"), c("ordering_date")), "_end": F.coalesce(c("source_end").cast("timestamp"), c("ordering_date")), "_kind": c("ordering_date").isNull().cast("int"),
    })
    own = checkpointed(sliced_sessions(own, [key, "_kind"], "_start", "_end", gap, [F.coalesce("event_date", F.to_date("_start")), "event_id"], slices, last=True))
    dealt = [key, "_kind", "_slice"]
    # what is known of a key: its last dated episode and that one's end, or the end of its undated events
    ends = own.groupBy(*dealt, "episode").agg(F.max("_end").alias("top"))
    facts = ends.groupBy(key, "_kind").agg(F.max("episode").alias("_last"), F.max_by("top", F.struct("episode", "top")).alias("_of_last"), F.max("top").alias("_of_all"))
    facts = facts.groupBy(key).agg(F.min("_kind").alias("_which"), F.min_by(F.when(c("_kind") == 0, c("_last")), "_kind").alias("_last"), F.min_by(F.when(c("_kind") == 0, c("_of_last")).otherwise(c("_of_all")), "_kind").alias("_until"))
    told = _same(ends.select(*dealt).distinct(), facts, [key])
    own = _same(own, told, dealt).filter((c("_kind") == c("_which")) & (c("_last").isNull() | (c("episode") == c("_last"))) & ((c("_kind") == 1) | (c("ordering_date") >= c("_until") - gap)))
    spans = own.groupBy(*dealt).agg(F.min("source_start").alias("a"), F.max("source_end").alias("z"), F.count("*").alias("n"))
    whole, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*dealt, F.min("a").over(whole).alias("episode_start"), F.max("z").over(whole).alias("episode_end"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*dealt).orderBy(F.asc_nulls_last("_start"), F.asc_nulls_last("event_date"), "event_id"))
    own = _same(own, spans, dealt).withColumn("position", (place + c("_before")).cast("int"))
    return own.drop("_start", "_end", "_kind", "_slice", "_last", "_which", "_until", "_before")


def nearest_prior(events: DataFrame, key: str, time: str, is_first: Column, is_second: Column) -> DataFrame:
    """(key, days): the fewest whole days from a first-kind event to a second-kind one at or after it. The nearest
    earlier partner gives the least, so that a running maximum replaces the pairs."""
    return events.select(key, days_since([key], time, is_first, is_second).alias("days")).groupBy(key).agg(F.min("days").alias("days"))


def days_since(keys: list[str], time: str, is_first: Column, is_second: Column) -> Column:
    """Whole days from the nearest first-kind event at or before a second-kind one; null for others."""
    before = F.max(F.when(is_first, F.col(time))).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(is_second, F.floor((F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))) / 86400))

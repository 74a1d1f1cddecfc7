"""Saved searches against projects, and one alert for a user and event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


SELECTIONS = {"neighbourhoods": "p_neighbourhood", "categories": "p_category", "stages": "p_stage", "statuses": "p_status"}
#: Places to which the pairs of ``evaluate`` are dealt.
DEALS = 32


def evaluate(projects: DataFrame, searches: DataFrame) -> DataFrame:
    """Each saved search against each project: search_id, user_id, project_id, mismatches (codes), matches.

    It tells of every pair, so that its rows are the product of both, and for few searches or a page of projects;
    ``matching`` finds the pairs that match. Searches are copied to ``DEALS`` places, to which projects are dealt by key.
    Range criteria with no value on the project's side fail; empty selections accept all; selections compare normalised
    text. Columns of a search: search_id, user_id, active, neighbourhoods, categories, stages, statuses (arrays), min_value,
    max_value, min_units, max_units, min_confidence.
    """
    asked = sought(searches).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    both = sides(projects).withColumn("_deal", F.pmod(F.xxhash64("project_id"), F.lit(DEALS)).cast("int")).join(asked, "_deal")
    codes = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks()])
    own = both.select("search_id", "user_id", "project_id", F.array_compact(codes).alias("mismatches"))
    return own.withColumn("matches", F.size("mismatches") == 0)


def matching(projects: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, user_id, project_id) of the pairs that match; searches that are not active take no part. They meet over an
    inverted index of what searches ask for (``searchindex``)."""
    from . import searchindex

    return searchindex.match(projects, searches)


def _bounded(value: Column, low: Column, high: Column | None = None) -> Column:
    """Whether a value lies in a range with open ends; one without any bound accepts a missing value too."""
    high = F.lit(None) if high is None else high
    free = low.isNull() & high.isNull()
    return F.coalesce(free | (value.isNotNull() & (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))), F.lit(False))


def sides(projects: DataFrame) -> DataFrame:
    """What searches look at of each project: numbers, and normalised texts in arrays. Names of categories, stages and most
    statuses are plain ASCII; the neighbourhood's name may have accents."""
    c = F.col
    plain = lambda name: text.searchable(c(name).cast("string"), ascii_only=True)
    return projects.select(
        "project_id", c("value").alias("p_value"), c("units").alias("p_units"), c("confidence").alias("p_confidence"),
        F.array(plain("neighbourhood_id"), text.searchable(c("neighbourhood_name").cast("string"))).alias("p_neighbourhood"), F.array(plain("effective_category")).alias("p_category"), F.array(plain("effective_stage")).alias("p_stage"), F.array(text.searchable(c("permit_status").cast("string"))).alias("p_status"),
    )


def sought(searches: DataFrame) -> DataFrame:
    """Searches with normalised, distinct selections; null ones are empty."""
    return searches.withColumns({k: F.array_distinct(_normal(F.col(k))) for k in SELECTIONS})


def _normal(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array()), lambda v: F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", " ")))


def checks() -> list[tuple[str, Column]]:
    """(code, whether the pair passes) of each criterion, over a row of ``sides`` and one of ``sought``."""
    c = F.col
    chosen = lambda k: (F.size(k) == 0) | F.arrays_overlap(SELECTIONS[k], k)
    return [
        ("inactive", F.coalesce(c("active"), F.lit(True))),
        ("neighbourhood", chosen("neighbourhoods")),
        ("category", chosen("categories")),
        ("construction-value", _bounded(c("p_value"), c("min_value"), c("max_value"))),
        ("units", _bounded(c("p_units"), c("min_units"), c("max_units"))),
        ("confidence-score", _bounded(c("p_confidence"), c("min_confidence"))),
        ("stage", chosen("stages")),
        ("permit-status", chosen("statuses")),
    ]


def alert_key(user: Column, event: Column) -> Column:
    """alert:v1:user:event, percent-encoded; null if either part is missing."""
    u, e = text.strip(user.cast("string")), text.strip(event.cast("string"))
    return F.when((u != "") & (e != ""), F.concat(F.lit("alert:v1:"), text.uri_part(u), F.lit(":"), text.uri_part(e)))


def new_alerts(candidates: DataFrame, sent: DataFrame) -> DataFrame:
    """Candidates (user_id, event_id, ...) without those whose key was sent; one row for a key, the smallest search_id."""
    keyed = candidates.withColumn("alert_key", alert_key(F.col("user_id"), F.col("event_id"))).filter(F.col("alert_key").isNotNull())
    one = keyed.groupBy("alert_key").agg(F.min_by(F.struct("user_id", "event_id", "search_id", "project_id"), F.struct("search_id", "project_id")).alias("a")).select("alert_key", "a.*")
    return one.join(sent.select("alert_key"), "alert_key", "left_anti")

"""Neighbourhood names: the authoritative list with its bounds, and names that permits bring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# What a sound list looks like.
ROWS = (300, 750)
LATITUDES, LONGITUDES = (53.0, 54.0), (-114.5, -112.5)
AUTHORITY, FROM_PERMITS = "CITY_CURRENT_CENTROIDS", "PERMIT"
# end of the fixed values


class InvalidNeighbourhoods(ValueError):
    pass


def normalize(raw: DataFrame) -> DataFrame:
    """(city_id, name, latitude, longitude, sound) of number, name_mixed, latitude, longitude."""
    name = F.regexp_replace(text.strip(F.col("name_mixed")), r"\s+", " ")
    own = raw.select(text.clean(F.col("number").cast("string"), 100).alias("city_id"), text.composed(name).alias("name"), text.number(F.col("latitude").cast("string")).alias("latitude"), text.number(F.col("longitude").cast("string")).alias("longitude"))
    sound = F.col("city_id").isNotNull() & (F.length("name") > 0) & ~F.col("name").rlike(r"\p{Cntrl}") & F.col("latitude").between(*LATITUDES) & F.col("longitude").between(*LONGITUDES)
    return own.withColumn("sound", F.coalesce(sound, F.lit(False)))


def checked(raw: DataFrame, rows: tuple[int, int] = ROWS) -> DataFrame:
    """The list, in order of its numbers, or an error if any row or the whole is not as it must be."""
    own = normalize(raw)
    seen = own.agg(F.count("*").alias("n"), F.count_if(~F.col("sound")).alias("bad"), F.count_distinct("city_id").alias("ids")).first()
    if seen.bad or not rows[0] <= seen.n <= rows[1] or seen.ids != seen.n:
        raise InvalidNeighbourhoods(f"{seen.n} rows, {seen.bad} not sound, {seen.ids} identifiers")
    return own.drop("sound").orderBy(F.expr("try_cast(city_id as bigint)").asc_nulls_last(), "city_id")


def with_precedence(existing: DataFrame, permits: DataFrame, authority: DataFrame) -> DataFrame:
    """(city_id, name, name_source, change): the authority's name wins over any other and is never replaced by one that a
    permit brings; of permits' names the one seen last (observed_at, then name) counts. ``change`` against ``existing``
    (city_id, name, name_source): created, updated or unchanged."""
    brought = permits.filter(F.col("city_id").isNotNull() & F.col("name").isNotNull()).groupBy("city_id").agg(F.max_by("name", F.struct("observed_at", "name")).alias("p_name"))
    old = existing.select("city_id", F.col("name").alias("e_name"), F.col("name_source").alias("e_source"))
    both = old.join(brought, "city_id", "full_outer").join(authority.select("city_id", F.col("name").alias("a_name")), "city_id", "full_outer")
    held = F.when(F.col("e_source") == AUTHORITY, F.col("e_name"))
    name = F.coalesce("a_name", held, "p_name", "e_name")
    source = F.when(F.col("a_name").isNotNull() | held.isNotNull(), AUTHORITY).otherwise(FROM_PERMITS)
    change = F.when(F.col("e_name").isNull(), "created").when((name == F.col("e_name")) & (source == F.col("e_source")), "unchanged").otherwise("updated")
    return both.select("city_id", name.alias("name"), source.alias("name_source"), change.alias("change"))

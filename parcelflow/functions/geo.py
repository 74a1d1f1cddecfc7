"""The area policy: point in polygon as a fold over literal edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The core area's ring (longitude latitude), and the envelope of plausible coordinates.
CORE_RING = """
-113.35697000379233 53.483373895780964, -113.36741766739655 53.48254584128468, -113.37316312439616 53.482766977004054, -113.39094160272089 53.48724561404801,
-113.4059871807331 53.48812883965392, -113.42092702794824 53.48752055227923, -113.44022597337128 53.48572150424796, -113.45511537471205 53.48518225655588,
-113.47746165622715 53.48159217216245, -113.4847550790907 53.480939740745356, -113.49946943081844 53.48101621416156, -113.51131184185643 53.4827355100292,
-113.52179929249584 53.48352483445412, -113.56568208063332 53.4830046126693, -113.56714169461257 53.5017190723483, -113.56828250488752 53.50203660335712,
-113.57163553213746 53.50012209898835, -113.57346778845654 53.51187276858149, -113.58121781050853 53.5129716978052, -113.58869705987584 53.51240765249048,
-113.65851819301379 53.51267226858441, -113.65829670447715 53.555851032697824, -113.66091981399265 53.573277436155955, -113.64667679925087 53.57289880790801,
-113.6288812917257 53.57122273906867, -113.62424438998517 53.571191154037855, -113.57975730808207 53.58085778687171, -113.53668770146069 53.580138377444754,
-113.5187731062456 53.58046859474017, -113.5129198953943 53.58147791616973, -113.50701675875302 53.58090473401503, -113.47282077067392 53.58086904261593,
-113.46821395815304 53.58171309992836, -113.45798261530223 53.58199271533086, -113.45545920393211 53.581622303668546, -113.44930111719239 53.57801399723654,
-113.43718302907011 53.57784483449259, -113.43383009880353 53.578271067980715, -113.42794881331834 53.581133480245654, -113.41935769919861 53.581982212504336,
-113.40916817374662 53.58113935460236, -113.39291939614336 53.57732065272376, -113.37662250915662 53.5722541499053, -113.37505818358761 53.572354153555835,
-113.37058869472776 53.569512267158416, -113.36879781517098 53.569880995983944, -113.35697000379363 53.569275649629496, -113.35697000379233 53.483373895780964
"""
ENVELOPE = {"latitude": (53.3, 53.8), "longitude": (-113.8, -113.2)}
MAP_ENVELOPE = {"latitude": (53.2, 53.9), "longitude": (-114.0, -113.0)}
# end of the fixed values

EPSILON = 1e-10


def ring(text: str = CORE_RING) -> list[tuple[float, float]]:
    return [tuple(map(float, p.split())) for p in text.replace("\n", " ").split(",")]


def _edges(points: list[tuple[float, float]]) -> Column:
    """The ring's edges as one literal, told to Spark as a text: a column for each number takes seconds to build."""
    edges = [f"named_struct('ax', {a[0]!r}D, 'ay', {a[1]!r}D, 'bx', {b[0]!r}D, 'by', {b[1]!r}D)" for a, b in zip(points, points[1:] + points[:1])]
    return F.expr(f"array({', '.join(edges)})")


def _on_edge(x: Column, y: Column):
    def test(e: Column) -> Column:
        cross = (y - e.ay) * (e.bx - e.ax) - (x - e.ax) * (e.by - e.ay)
        near = lambda v, p, q: (v >= F.least(p, q) - EPSILON) & (v <= F.greatest(p, q) + EPSILON)
        return (F.abs(cross) <= EPSILON) & near(x, e.ax, e.bx) & near(y, e.ay, e.by)

    return test


def _crossed(x: Column, y: Column):
    def count(total: Column, e: Column) -> Column:
        rise = F.when(e.by == e.ay, F.lit(1.0)).otherwise(e.by - e.ay)  # level edges cross nothing; no division by zero
        crosses = ((e.ay > y) != (e.by > y)) & (x < (e.bx - e.ax) * (y - e.ay) / rise + e.ax)
        return total + crosses.cast("int")

    return count


def covers(x: Column, y: Column, outer: list[tuple[float, float]], holes: list[list[tuple[float, float]]] = ()) -> Column:
    """Whether a polygon covers a point: its boundaries count, the insides of holes do not."""
    def inside(points: list[tuple[float, float]]) -> Column:
        return F.aggregate(_edges(points), F.lit(0), _crossed(x, y)) % 2 == 1

    def boundary(points: list[tuple[float, float]]) -> Column:
        return F.exists(_edges(points), _on_edge(x, y))

    found = boundary(outer) | inside(outer)
    for hole in holes:
        found = found & (boundary(hole) | ~inside(hole))
    return found


def within(latitude: Column, longitude: Column, envelope: dict) -> Column:
    return F.coalesce(latitude.between(*envelope["latitude"]) & longitude.between(*envelope["longitude"]), F.lit(False))


def area_class(latitude: Column, longitude: Column, points: list[tuple[float, float]] | None = None, envelope: dict = ENVELOPE) -> Column:
    """CORE, OUTSIDE_CORE, or UNKNOWN where coordinates are missing or implausible."""
    y, x = latitude.cast("double"), longitude.cast("double")
    return F.when(~within(y, x, envelope) | F.isnan(y) | F.isnan(x), "UNKNOWN").when(covers(x, y, points or ring()), "CORE").otherwise("OUTSIDE_CORE")

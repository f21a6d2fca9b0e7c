"""Nearest cells by a space-filling index: on an axis, around a circle of longitude, or on the sphere.

Places become points of a unit line, circle or sphere, so neither a wrapped axis, nor a pole, nor a grid with two-dimensional
coordinates is special. A box around all of them is cut in halves per dimension again and again; the digits of the cuts, interleaved, are
the key of a tile (a Morton code), so that the key of the tile above is a shift. The index is one row per non-empty tile with
the bounds of its places.

A search goes down the tiles: of the tiles that a point may still need, those below are looked up by an equal key, the tile
whose farthest corner is nearest bounds the answer, and tiles that lie beyond it are dropped. A point that lies
among the places follows a handful of tiles on each level; one outside follows the edge nearest to it. Only the places of the last
tiles are compared, and the answer is exact. Equal points are searched once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import haversine_miles
from cellwright.session import settle

#: Squared distances this close count as equal while tiles are dropped; what is left is compared exactly.
SLACK = 1e-11


class Space(NamedTuple):
    """How a place becomes a point: its dimensions, their common bounds, and the cuts per level and levels of the index."""

    point: Callable[..., list[Column]]
    low: float
    span: float
    bits: int
    levels: int


def _line(x: Column) -> list[Column]:
    return [x]


def _circle(degrees: Column) -> list[Column]:
    return [F.cos(F.radians(degrees)), F.sin(F.radians(degrees))]


def _sphere(lat: Column, lon: Column) -> list[Column]:
    return [F.cos(F.radians(lat)) * c for c in _circle(lon)] + [F.sin(F.radians(lat))]


LINE = Space(_line, -400.0, 800.0, 6, 2)
CIRCLE = Space(_circle, -1.0, 2.0, 6, 2)
SPHERE = Space(_sphere, -1.0, 2.0, 2, 5)


def _key(space: Space, dims: list[Column]) -> Column:
    """The tile of the last level: each dimension's place on a grid, its bits interleaved level by level."""
    steps = 1 << (space.bits * space.levels)
    places = [F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((d - space.low) / space.span * steps))).cast("long") for d in dims]
    key = F.lit(0).cast("long")
    for level in range(space.levels):
        for n, place in enumerate(places):
            digit = F.shiftright(place, space.bits * level).bitwiseAND(F.lit((1 << space.bits) - 1))
            key = key + F.shiftleft(digit, space.bits * (len(dims) * level + n))
    return key


def _indexed(places: DataFrame, space: Space, coordinates: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The places with their points and tiles, and the tiles of each level from the top. `places` is a stored table or made of one."""
    dims = space.point(*[F.col(c) for c in coordinates])
    names = [f"_d{n}" for n in range(len(dims))]
    held = places.withColumns({**dict(zip(names, dims, strict=True)), "_tile": _key(space, dims)})
    bounds = [f(F.col(n)).alias(f"{n}_{side}") for n in names for side, f in (("lo", F.min), ("hi", F.max))]
    last = held.groupBy("_tile").agg(*bounds)
    shift, levels = space.bits * len(dims), []
    for level in range(1, space.levels + 1):
        above = shift * (space.levels - level)
        merged = [f(F.col(f"{n}_{side}")).alias(f"{n}_{side}") for n in names for side, f in (("lo", F.min), ("hi", F.max))]
        tiles = last.groupBy(F.shiftright("_tile", above).alias("_tile")).agg(*merged)
        levels.append(tiles.withColumn("_above", F.shiftright("_tile", shift)))
    return held, levels


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def nearest(points: DataFrame, places: DataFrame, space: Space, sought: Sequence[str], coordinates: Sequence[str], rank: Column, keep: Sequence[str]) -> DataFrame:
    """Each distinct point (`sought`) with the columns `keep` of the place that is least by `rank`.

    rank: an expression over `sought`, `coordinates` and `keep` that orders places by distance and then breaks ties.
    A point with a missing coordinate has no row, nor has any point where there are no places.
    """
    dims = space.point(*[F.col(c) for c in sought])
    wanted = points.select(*sought).distinct()
    for c in sought:
        wanted = wanted.where(F.col(c).isNotNull() & ~F.isnan(c))
    for c in coordinates:
        places = places.where(F.col(c).isNotNull() & ~F.isnan(c))
    names = [f"_p{n}" for n in range(len(dims))]
    # the root is above every tile, that of the point as well; below it are 2**(bits * dims) tiles at most, and each may hold the answer
    root = F.shiftright(_key(space, dims), space.bits * len(dims) * space.levels)
    front = wanted.withColumns({**dict(zip(names, dims, strict=True)), "_at": root})
    held, levels = _indexed(places.select(*dict.fromkeys([*coordinates, *keep])), space, coordinates)
    each = Window.partitionBy(*sought)
    for tiles in levels:
        met = front.join(tiles, F.col("_at") == F.col("_above"))
        low, high = [], []
        for n in range(len(dims)):
            p, lo, hi = F.col(f"_p{n}"), F.col(f"_d{n}_lo"), F.col(f"_d{n}_hi")
            low.append(F.pow(F.greatest(lo - p, p - hi, F.lit(0.0)), 2))
            high.append(F.pow(F.greatest(F.abs(p - lo), F.abs(p - hi)), 2))
        met = met.withColumns({"_low": _sum(low), "_best": F.min(_sum(high)).over(each)}).where(F.col("_low") <= F.col("_best") * (1 + SLACK) + SLACK)
        front = met.select(*sought, *names, F.col("_tile").alias("_at"))
    met = front.join(held, F.col("_at") == F.col("_tile"))
    best = F.min(F.struct(rank.alias("r"), *[F.col(c) for c in keep]))
    return met.groupBy(*sought).agg(best.alias("_b")).select(*sought, *[F.col(f"_b.{c}").alias(c) for c in keep])


def nearest_on_axis(points: DataFrame, axis: DataFrame, point: str, center: str, *, circle: bool = False) -> DataFrame:
    """Add the nearest axis center of each point; the larger center on ties, the edge center when outside.

    circle: degrees of longitude, where -179 and 181 are one place. A missing point has no center.
    """
    apart = F.abs(F.col(point) - F.col(center))
    if circle:
        turns = F.pmod(apart, F.lit(360.0))
        apart = F.when(apart <= 180, apart).otherwise(F.least(turns, 360 - turns))
    rank = F.struct(apart.alias("d"), (-F.col(center)).alias("c"))
    found = nearest(points, axis.select(center).distinct(), CIRCLE if circle else LINE, [point], [center], rank, [center])
    return points.join(found, point, "left")


def nearest_place(points: DataFrame, places: DataFrame, keep: Sequence[str] = ("lat", "lon"), point: Sequence[str] = ("_lat", "_lon")) -> DataFrame:
    """Add the columns `keep` of the place nearest on the sphere, for grids of any kind; ties go to the larger latitude, then longitude.

    places: (lat, lon) rows with `keep`, one per cell of the grid.
    """
    miles = F.round(haversine_miles(*point, "lat", "lon"), 9)
    rank = F.struct(miles.alias("d"), (-F.col("lat")).alias("a"), (-F.col("lon")).alias("b"))
    places = settle(places.select(*dict.fromkeys(["lat", "lon", *keep])).distinct(), "places")  # the one reading of them
    found = nearest(points, places, SPHERE, list(point), ["lat", "lon"], rank, list(keep))
    return points.join(found, list(point), "left")

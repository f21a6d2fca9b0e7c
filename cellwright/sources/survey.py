"""The survey of a grid: its axes, granules and tiles, found in one pass and read instead of the cells.

A survey is a small table with one row per axis position, granule and tile. That of a written cube is kept beside its
cells, a part for each appended batch, and a batch counts as stored once its part is there. `survey` makes
the same table for any frame of cells. Sizes follow the grid and the number of granules, never the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.session import settle

TILE = 256
_BOUNDS = ["lat_lo", "lat_hi", "lon_lo", "lon_hi"]

SURVEY = T.StructType(
    [T.StructField("collection", T.StringType()), T.StructField("kind", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("position", "tile_i", "tile_j")]
    + [T.StructField("granule_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("ts_to", T.TimestampType())]
    + [T.StructField(n, T.DoubleType()) for n in _BOUNDS]
    + [T.StructField("cells", T.LongType()), T.StructField("tile", T.IntegerType()), T.StructField("stored_schema", T.StringType())]
)


def tile_of(position: str, tile: int) -> Column:
    return F.floor(F.col(position) / tile).cast("int")


def facts(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """The survey's rows in one pass: every grouping is combined in the tasks that read the cells.

    Frames without a collection, granules or times are one unnamed collection without such rows.
    """
    blank = {"collection": "string", "granule_id": "string", "ts": "timestamp"}
    rows = cells.select(
        *[F.col(c).cast(k).alias(c) if c in cells.columns else F.lit(None).cast(k).alias(c) for c, k in blank.items()],
        "i", "j", "lat", "lon", tile_of("i", tile).alias("tile_i"), tile_of("j", tile).alias("tile_j"),
    )
    sets = {"lat": ["i"], "lon": ["j"], "granule": ["granule_id", "ts"], "tile": ["tile_i", "tile_j"]}
    columns = [c for s in sets.values() for c in s]
    grouped = rows.groupingSets([["collection", *s] for s in sets.values()], "collection", *columns).agg(
        *[F.grouping(F.col(s[0])).alias(f"_{kind}") for kind, s in sets.items()],
        F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"),
        F.count(F.lit(1)).alias("cells"),
    )
    kind = F.coalesce(*[F.when(F.col(f"_{k}") == 0, k) for k in sets])
    return grouped.select(
        "collection", kind.alias("kind"), F.coalesce("i", "j").alias("position"), "tile_i", "tile_j", "granule_id", "ts", F.col("ts").alias("ts_to"), *_BOUNDS, "cells",
        F.lit(tile).alias("tile"), F.lit(None).cast("string").alias("stored_schema"),
    )


def survey(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """The survey of a frame that is not a written cube."""
    return settle(facts(cells, tile), "survey")


def axis(found: DataFrame, kind: str) -> DataFrame:
    """collection, position, coordinate and `to` of the `lat` or `lon` axis; `to` differs where a position has several coordinates."""
    return found.where(F.col("kind") == kind).groupBy("collection", "position").agg(
        F.min(f"{kind}_lo").alias("coordinate"), F.max(f"{kind}_hi").alias("to"), F.max("tile").alias("tile"))


def centers(found: DataFrame, kind: str) -> DataFrame:
    """The distinct coordinates of an axis, as a column named `lat` or `lon`."""
    return axis(found, kind).where("coordinate IS NOT NULL").select(F.col("coordinate").alias(kind)).distinct()


def granules(found: DataFrame) -> DataFrame:
    """collection, granule_id and ts of every granule, with its cells."""
    return found.where("kind = 'granule'").groupBy("collection", "granule_id", "ts").agg(F.sum("cells").alias("cells"))


def timesteps(found: DataFrame) -> DataFrame:
    return granules(found).where("ts IS NOT NULL").select("ts").distinct()


def tiles(found: DataFrame) -> DataFrame:
    """collection, tile_i, tile_j and the bounds of the cells in each tile."""
    return found.where("kind = 'tile'").groupBy("collection", "tile_i", "tile_j").agg(
        F.min("lat_lo").alias("lat_lo"), F.max("lat_hi").alias("lat_hi"), F.min("lon_lo").alias("lon_lo"), F.max("lon_hi").alias("lon_hi"),
        F.sum("cells").alias("cells"), F.max("tile").alias("tile"))


def extents(found: DataFrame) -> DataFrame:
    """One row: extent and number of centers of both axes."""
    per = {k: (F.when(F.col("kind") == k, F.col(f"{k}_lo")), F.when(F.col("kind") == k, F.col(f"{k}_hi"))) for k in ("lat", "lon")}
    return found.groupBy().agg(*[x for k, (lo, hi) in per.items() for x in (
        F.min(lo).alias(f"{k}_min"), F.max(hi).alias(f"{k}_max"), F.count_distinct(lo).alias(f"n_{k}"))])


def lowest(rows: DataFrame, column: Column | str) -> Column:
    """The least value as a bound that reaches the Parquet reader of the frame it filters.

    Several aggregates over one table would be merged into one subquery of several columns, which is not pushed down.
    """
    found = rows.select(F.col(column).alias("v") if isinstance(column, str) else column.alias("v")).where("v IS NOT NULL")
    return found.orderBy("v").limit(1).scalar()


def highest(rows: DataFrame, column: Column | str) -> Column:
    found = rows.select(F.col(column).alias("v") if isinstance(column, str) else column.alias("v")).where("v IS NOT NULL")
    return found.orderBy(F.desc("v")).limit(1).scalar()

"""Satellite cells beside ground monitors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.aggregates import pearson
from cellwright.functions.scalars import is_finite, site_id
from cellwright.operators.cellindex import nearest_on_axis, nearest_place
from cellwright.operators.ground import located
from cellwright.session import settle
from cellwright.sources.survey import centers, highest, lowest, survey


def join_flag(science: DataFrame, flags: DataFrame, on: Sequence[str] = ("ts", "i", "j")) -> DataFrame:
    """Align science and flag rows on shared coordinates; needless when the flag is a column already."""
    return science.join(flags, list(on))


def nearest_cell(monitors: DataFrame, grid: DataFrame) -> DataFrame:
    """Each monitor with the coordinates of its cell: nearest latitude and longitude independently.

    `grid` is the survey of the grid (`sources.survey`); no cell is read. Longitudes are compared around the
    circle, so a grid on 0..360 and monitors on -180..180 meet.
    """
    placed = located(monitors)
    placed = nearest_on_axis(placed, centers(grid, "lat").withColumnRenamed("lat", "cell_lat"), "_lat", "cell_lat")
    placed = nearest_on_axis(placed, centers(grid, "lon").withColumnRenamed("lon", "cell_lon"), "_lon", "cell_lon", circle=True)
    return placed.withColumn("site_id", site_id()).drop("_lat", "_lon")


def nearest_swath_cell(monitors: DataFrame, cells: DataFrame) -> DataFrame:
    """Each monitor with the cell nearest to it on the sphere, for grids whose coordinates are two-dimensional.

    The coordinates are the one thing read of the cells.
    """
    places = cells.select("i", "j", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), "lat", "lon").distinct()
    placed = nearest_place(located(monitors), places, ["i", "j", "cell_lat", "cell_lon"])
    return placed.withColumn("site_id", site_id()).drop("_lat", "_lon")


def at_places(cells: DataFrame, where: DataFrame) -> DataFrame:
    """Cell rows at the given (lat, lon) rows. The places are written first: their bounds reach the reader, and Spark knows their size."""
    where = settle(where, "where")
    for c in ("lat", "lon"):
        cells = cells.where((F.col(c) >= lowest(where, c)) & (F.col(c) <= highest(where, c)))
    return cells.join(where, ["lat", "lon"])


def at_monitors(monitors: DataFrame, cells: DataFrame, grid: DataFrame | None = None, *, swath: bool = False) -> DataFrame:
    """Cell rows of every monitor: narrowed to the cell before any mask. `grid` is the survey, kept or made here in one pass."""
    near = nearest_swath_cell(monitors, cells) if swath else nearest_cell(monitors, survey(cells) if grid is None else grid)
    return at_places(cells, near.select("site_id", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")).distinct())


def series_coverage(rows: DataFrame, monitors: DataFrame, steps: DataFrame) -> DataFrame:
    """Timesteps of the grid, those with a valid value at the monitor's cell, those without, and the valid share.

    Every monitor has a row. A timestep for which the grid holds no row of the cell counts as one
    without a value. `steps` holds the grid's timesteps as `ts`, from its survey.
    """
    sites = monitors.select(site_id().alias("site_id")).distinct()
    total_steps = steps.where(F.col("ts").isNotNull()).agg(F.count_distinct("ts")).scalar()
    held = rows.where(is_finite("value")).groupBy("site_id").agg(F.count_distinct("ts").alias("n_valid"))
    valid, total = F.coalesce("n_valid", F.lit(0).cast("long")), F.col("n_total")
    return sites.join(held, "site_id", "left").withColumn("n_total", total_steps).select(
        "site_id", "n_total", valid.alias("n_valid"), (total - valid).alias("n_excluded"),
        F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("coverage_fraction"),
    )


def pair_daily(rows: DataFrame, ground: DataFrame) -> DataFrame:
    """Daily satellite means beside ground values; dates on one side only are dropped.

    `ground` holds (site_id, date, ground) with one row per site and date.
    """
    daily = rows.where(is_finite("value")).groupBy("site_id", F.to_date("ts").cast("string").alias("date")).agg(
        F.avg("value").alias("satellite")
    )
    return daily.join(ground.where(F.col("ground").isNotNull()), ["site_id", "date"])


def correlation_stats(pairs: DataFrame, ground: DataFrame | None = None, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Pearson r, pair count and the share of ground days that were paired."""
    stats = pairs.groupBy(*keys).agg(pearson("satellite", "ground").alias("r"), F.count(F.lit(1)).alias("n"))
    if ground is None:
        return stats.withColumn("coverage_fraction", F.when(F.col("n") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    days = ground.groupBy(*keys).agg(F.count(F.lit(1)).alias("_days"))
    return stats.join(days, list(keys)).withColumn("coverage_fraction", F.col("n") / F.col("_days")).drop("_days")

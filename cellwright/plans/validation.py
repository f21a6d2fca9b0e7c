"""Satellite series against ground monitors over a region."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators import ground as G
from cellwright.operators import joint as J
from cellwright.operators.regions import Box
from cellwright.session import settle
from cellwright.sources.survey import survey, timesteps


def region_monitors(monitors: DataFrame, box: Box, k: int) -> DataFrame:
    """Monitors of the first search box around the region that holds at least `k`.

    One box needs no join: a single aggregate counts every step, and its choice filters the rows.
    """
    placed = G.located(monitors).withColumn("_step", G.first_step(*[F.lit(float(box[n])) for n in (1, 3, 0, 2)]))
    near = placed.where(F.col("_step").isNotNull())
    chosen = near.groupBy().agg(*G.step_counts(F.lit(1))).select(G.chosen_step(k)).scalar()
    return near.where(F.col("_step") <= chosen).drop("_step", "_lat", "_lon")


def daily_means(records: DataFrame) -> DataFrame:
    """Ground mean per site and date with its units, over all sites."""
    return G.ground_summary(records, "daily", cap=None).select(
        "site_id", F.col("period").alias("date"), F.col("mean").alias("ground"), F.col("units").alias("ground_units")
    )


def stated_units(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The units that a group's rows state; several are listed, none is NULL."""
    told = F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("ground_units"), F.lit("")))), ", ")
    return rows.groupBy(*keys).agg(F.nullif(told, F.lit("")).alias("ground_units"))


def validate_against_ground(
    cells: DataFrame, monitors: DataFrame, records: DataFrame, mask: Callable[[DataFrame], DataFrame], box: Box, k: int = 10,
    grid: DataFrame | None = None, units: str | None = None,
) -> DataFrame:
    """Correlation, pair count, coverage and both units of every site, paired or not, and a pooled row with a NULL site.

    `units` are those of the cells. The pooled row is over the sites' pairs, whatever units they state.

    The grid's survey, kept or made here in one pass, gives the cells of the sites and the timesteps; the cells themselves
    are read once, within the bounds of those sites.
    """
    grid = survey(cells) if grid is None else grid
    sites = region_monitors(monitors, box, k)
    rows = settle(mask(J.at_monitors(sites, cells, grid)), "series")
    ground = settle(daily_means(records), "ground")
    pairs = settle(J.pair_daily(rows, ground), "pairs")
    coverage = J.series_coverage(rows, sites, timesteps(grid)).withColumnRenamed("coverage_fraction", "series_coverage")
    site = coverage.join(J.correlation_stats(pairs, ground), "site_id", "left").na.fill({"n": 0, "coverage_fraction": 0.0})
    site = site.join(stated_units(ground, ["site_id"]), "site_id", "left")
    pooled = J.correlation_stats(pairs, None, ()).where(F.col("n") > 0).withColumn("ground_units", stated_units(pairs, []).scalar())
    columns = ["site_id", "r", "n", "coverage_fraction", "n_total", "n_valid", "n_excluded", "series_coverage", "ground_units"]
    both = site.select(columns).unionByName(pooled, allowMissingColumns=True).select(columns)
    return both.withColumn("satellite_units", F.lit(units).cast("string"))


def exceedance_overlay(
    cells: DataFrame, monitors: DataFrame, records: DataFrame, mask: Callable[[DataFrame], DataFrame], box: Box,
    k: int = 10, field: str = "first_max_value", hard: float | None = None, percentile: float | None = None, grid: DataFrame | None = None,
) -> DataFrame:
    """Satellite series of every monitor that exceeded, with `exceeded` on the exceedance dates.

    Monitors without an exceedance are dropped before the cells are read for them.
    """
    sites = region_monitors(monitors, box, k)
    dates = settle(G.exceedance_dates(records, field, hard, percentile), "dates")
    sites = sites.withColumn("site_id", J.site_id()).join(dates.select("site_id").distinct(), "site_id", "left_semi").drop("site_id")
    rows = mask(J.at_monitors(sites, cells, grid))
    marked = rows.withColumn("date", F.to_date("ts").cast("string")).join(
        dates.withColumn("exceeded", F.lit(True)), ["site_id", "date"], "left"
    )
    return marked.select("site_id", "ts", "value", F.coalesce("exceeded", F.lit(False)).alias("exceeded"))

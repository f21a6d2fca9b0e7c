"""Maps and comparisons: crop, mask, reduce over time, describe, thin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.scalars import sig7
from cellwright.operators import comparison, display, order_stats, provenance, reductions
from cellwright.session import settle


def heatmap(cells: DataFrame, cadence: str, keys: Sequence[str], max_cells: int | None = None) -> DataFrame:
    """Temporal-mean cells of each panel with the panel's scale and full-field statistics; thinned only to a given number.

    `cells` are narrowed and masked. All panels share one plan; a panel's facts are one row per key.
    """
    keys = list(keys)
    field = settle(reductions.temporal_mean(cells, cadence, keys), "field")
    stats = reductions.field_statistics(field, keys)
    scale = comparison.percentile_bounds(field, keys)
    shown = field if max_cells is None else display.thin_grid(field, keys, max_cells=max_cells)
    return shown.join(stats, keys).join(scale, keys).select(
        *keys, "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), sig7("value").alias("value"),
        sig7("vmin").alias("vmin"), sig7("vmax").alias("vmax"), "count", "valid_fraction", "mean", "min", "max",
    )


def region_comparison(cells: DataFrame, cadence: str, side: str = "side") -> DataFrame:
    """Period-mean statistics of each side with one shared scale; no differencing.

    The medians of the sides and the scale of both come from one selection, in which both together are a third group.
    """
    field = settle(reductions.temporal_mean(cells, cadence, [side]), "field")
    groups = field.select(F.explode(F.array(F.col(side).cast("string"), F.lit(None).cast("string"))).alias("_g"), "value")
    picked = settle(order_stats.quantiles(groups, ["_g"], "value", {"median": 0.5, "p2": 0.02, "p98": 0.98}), "picked")
    scale = comparison.bounds(picked.where(F.col("_g").isNull())).select(F.struct("vmin", "vmax")).scalar()
    stats = comparison.side_stats(field, [side]).join(picked.select(F.col("_g").alias(side), "median"), side)
    return stats.select(side, "mean", "median", "max", "min", "n_pixels", F.lit("period-mean").alias("basis"), scale.alias("_s")).select("*", "_s.vmin", "_s.vmax").drop("_s")


def map_provenance(
    cells: DataFrame, cadence: str, keys: Sequence[str], stat: str = "mean", good=None, bad=None, stated: dict | None = None
) -> DataFrame:
    """What a map, a comparison or a regional statistic of these cells rests on: a row for each panel, and one for all of them if they are several."""
    panels = settle(provenance.panel_provenance(cells, keys, cadence, stat, good, bad, stated), "provenance")
    merged = provenance.merge_provenance(panels).where(F.size("panels") > 1)
    return panels.unionByName(merged)


def period_comparison(cells: DataFrame, cadence: str, side: str = "side") -> DataFrame:
    """B minus A of the two sides' temporal-mean fields on one grid."""
    field = settle(reductions.temporal_mean(cells, cadence, [side]), "field")
    return comparison.period_difference(field.where(F.col(side) == "A"), field.where(F.col(side) == "B"))

"""Thinning a field to what a map can show. Statistics are taken from the whole field first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.scalars import color_index, is_finite, sig7
from cellwright.operators import order_stats


def thin_grid(field: DataFrame, keys: Sequence[str] = (), *, max_cells: int) -> DataFrame:
    """Keep rows and columns at one stride when the grid has more than `max_cells` cells.

    The stride follows from the grid's extent, one small row per key.
    """
    shape = field.groupBy(*keys).agg(
        F.min("i").alias("_i0"), F.min("j").alias("_j0"),
        ((F.max("i") - F.min("i") + 1).cast("long") * (F.max("j") - F.min("j") + 1)).alias("_total"),
    )
    step = F.when(F.col("_total") <= max_cells, 1).otherwise(F.ceil(F.sqrt(F.col("_total") / max_cells)))
    shape = shape.withColumn("_step", step).drop("_total")
    if keys:
        rows = field.join(shape, list(keys))
    else:
        rows = field.withColumn("_s", shape.select(F.struct("_i0", "_j0", "_step")).scalar()).select(field["*"], "_s.*")
    on_stride = ((F.col("i") - F.col("_i0")) % F.col("_step") == 0) & ((F.col("j") - F.col("_j0")) % F.col("_step") == 0)
    return rows.where(on_stride).drop("_i0", "_j0", "_step")


def sample_points(field: DataFrame, keys: Sequence[str] = (), *, max_points: int) -> DataFrame:
    """At most `max_points` finite cells, evenly spaced in row-major order.

    Positions come from per-row counts of the grid plus the place inside a row, so no task ever
    sorts more than one row of the grid. A position p is taken when it is the whole part of a step
    of the even spacing from the first to the last cell.
    """
    keys = list(keys)
    cells = field.where(is_finite("value"))
    ranked = order_stats.ordinal(cells, keys, F.col("i"), ["j"], "_pos")
    group = keys or ["_all"]
    if not keys:
        ranked, cells = ranked.withColumn("_all", F.lit(0)), cells.withColumn("_all", F.lit(0))
    sizes = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        ranked = ranked.join(sizes, group)
    else:
        ranked = ranked.withColumn("_n", sizes.select("_n").scalar())
    # a single point is the first cell
    step = (F.col("_n") - 1).cast("double") / (max_points - 1) if max_points > 1 else F.lit(1.0)
    # The even spacing takes floor(k * step) for every k but the last, which is the last cell.
    near = F.ceil(F.col("_pos") / step)
    visited = F.col("_pos") == (F.col("_n") - 1 if max_points > 1 else F.lit(0))
    for k in (near - 1, near, near + 1):
        visited = visited | ((k <= max_points - 2) & (F.floor(k * step) == F.col("_pos")))
    kept = ranked.where(F.when(F.col("_n") <= max_points, F.lit(True)).otherwise(visited))
    return kept.select(*keys, "i", "j", "lat", "lon", sig7("value").alias("value"))


def colorize(field: DataFrame, bounds: DataFrame, keys: Sequence[str], n_colors: int = 256) -> DataFrame:
    """Colour table index of each cell against its panel's scale."""
    return field.join(bounds, list(keys)).withColumn("color", color_index("value", "vmin", "vmax", n_colors))

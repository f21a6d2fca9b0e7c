"""Comparing two sides: two regions, or two periods of one region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.aggregates import weighted_mean
from cellwright.functions.scalars import finite
from cellwright.operators import order_stats
from cellwright.operators.cellindex import nearest_on_axis
from cellwright.session import settle
from cellwright.sources.survey import centers, survey

# --- Fixed values ---------------------------------------------------------------------------------
PERCENT_CHANGE_FLOOR = 0.05
# --------------------------------------------------------------------------------------------------


def split_sources(cells: DataFrame, label_a: str | None = None, label_b: str | None = None) -> DataFrame:
    """Mark rows as side A or B by source label when both labels occur, else by `source_no`.

    Anything but exactly two sources gives no rows.
    """
    a, b = F.lit(label_a), F.lit(label_b)
    facts = cells.groupBy().agg(
        F.struct(
            F.count_distinct("source").alias("n"),
            (F.bool_or(F.col("source") == a) & F.bool_or(F.col("source") == b)).alias("labelled"),
            F.min("source_no").alias("first"),
        ).alias("f")
    ).scalar()
    by_label = F.when(F.col("source") == a, "A").when(F.col("source") == b, "B")
    by_place = F.when(F.col("source_no") == F.col("_f.first"), "A").otherwise("B")
    marked = cells.withColumn("_f", facts).where(F.col("_f.n") == 2)
    return marked.withColumn("side", F.when(F.coalesce("_f.labelled", F.lit(False)), by_label).otherwise(by_place)).drop("_f")


def align_grids(a: DataFrame, b: DataFrame, grid_a: DataFrame | None = None, grid_b: DataFrame | None = None) -> DataFrame:
    """Put field B on the grid of field A.

    Each row and column of A takes the nearest row and column of B, which is itself when the axes
    match. A cell of A further than one step of B from any cell of B has no partner. Only the axes
    are matched by distance; cells then meet on equal keys. The grids are surveys, kept or made here in one pass each.
    """
    grid_a, grid_b = survey(a) if grid_a is None else grid_a, survey(b) if grid_b is None else grid_b

    def mapped(axis: str) -> DataFrame:
        theirs = centers(grid_b, axis).select(F.col(axis).alias("_b"))
        step = theirs.groupBy().agg(
            F.coalesce(F.try_divide(F.max("_b") - F.min("_b"), F.count(F.lit(1)) - 1), F.lit(1.0)).alias("s")
        ).scalar()
        near = settle(nearest_on_axis(centers(grid_a, axis), theirs, axis, "_b", circle=axis == "lon"), "axes")
        apart = F.abs(F.col(axis) - F.col("_b"))
        apart = F.least(apart, F.abs(360 - apart)) if axis == "lon" else apart
        return near.where(apart <= step).select(axis, F.col("_b").alias(f"_{axis}"))

    left = a.select("i", "j", "lat", "lon", F.col("value").alias("a")).join(mapped("lat"), "lat").join(mapped("lon"), "lon")
    right = b.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("value").alias("b"))
    return left.join(right, ["_lat", "_lon"]).drop("_lat", "_lon")


def period_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """B minus A per cell of one grid; a cell missing on either side is left out."""
    left = a.select(*keys, "lat", "lon", F.col("value").alias("a")).where(F.col("a").isNotNull())
    right = b.select(*keys, F.col("value").alias("b")).where(F.col("b").isNotNull())
    return left.join(right, list(keys)).withColumn("diff", F.col("b") - F.col("a"))


def side_stats(field: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The statistics of a side that are combined before the shuffle; a side without values gives no row."""
    v = finite("value")
    return field.groupBy(*keys).agg(
        weighted_mean("value").alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("n_pixels")
    ).where(F.col("n_pixels") > 0)


def region_stats(field: DataFrame, keys: Sequence[str] = (), basis: str = "period-mean") -> DataFrame:
    """Area-weighted mean, median, max, min and cell count; a side without values gives no row."""
    stats = side_stats(field, keys)
    median = order_stats.quantiles(field, keys, "value", {"median": 0.5}).drop("n")
    if keys:
        stats = stats.join(median, list(keys))
    else:
        stats = stats.withColumn("median", median.select("median").scalar())
    return stats.withColumn("basis", F.lit(basis))


def percentile_bounds(field: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Colour scale bounds: the 2nd and 98th percentiles.

    Equal bounds widen by one percent (or one); no finite value gives 0 to 1.
    """
    return bounds(order_stats.quantiles(field, keys, value, {"p2": 0.02, "p98": 0.98}), keys)


def bounds(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bounds from the percentiles `p2` and `p98`."""
    delta = F.when(F.col("p2") == 0, F.lit(1.0)).otherwise(F.abs("p2") * 0.01)
    same = F.col("p2") == F.col("p98")
    return found.select(
        *keys,
        F.coalesce(F.when(same, F.col("p2") - delta).otherwise(F.col("p2")), F.lit(0.0)).alias("vmin"),
        F.coalesce(F.when(same, F.col("p98") + delta).otherwise(F.col("p98")), F.lit(1.0)).alias("vmax"),
    )


def shared_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """One colour scale for both panels."""
    return percentile_bounds(a.select("value").unionByName(b.select("value")))


def diverging_bounds(diff: DataFrame, value: str = "diff") -> DataFrame:
    """A scale symmetric around zero, sized by the 98th percentile of the magnitude."""
    top = order_stats.quantiles(diff.select(F.abs(value).alias("m")), [], "m", {"p98": 0.98})
    bound = F.when(F.coalesce("p98", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("p98"))
    return top.select((-bound).alias("vmin"), bound.alias("vmax"))


def anomaly_stats(diff: DataFrame, threshold: float | None = None) -> DataFrame:
    """Mean difference, percent change against the paired A mean, and the share of large changes.

    Percent change is withheld when A's mean is zero or small against A's own spread.
    """
    d = finite("diff")
    hit = F.abs(d) >= F.lit(float(threshold if threshold is not None else "inf"))
    one = diff.groupBy().agg(
        F.count(d).alias("n_cells"), weighted_mean("diff").alias("mean_difference"), weighted_mean("a").alias("mean_a"),
        F.count_if(hit).alias("n_exceeding"),
    )
    spread = order_stats.quantiles(diff.select(F.abs("a").alias("m")), [], "m", {"p2": 0.02, "p98": 0.98})
    floor = spread.select((F.col("p98") - F.col("p2")) * PERCENT_CHANGE_FLOOR).scalar()
    facts = one.withColumn("floor", floor)
    small = (F.col("mean_a") == 0) | F.coalesce(F.abs("mean_a") < F.col("floor"), F.lit(False))
    known = F.col("mean_difference").isNotNull() & F.col("mean_a").isNotNull()
    out = facts.select(
        "n_cells", "mean_difference",
        F.when(known & ~small, F.try_divide(F.col("mean_difference"), F.col("mean_a")) * 100).alias("percent_change"),
        (known & small).alias("percent_change_withheld"),
        "n_exceeding",
        F.coalesce(F.try_divide(F.col("n_exceeding"), F.col("n_cells")), F.lit(0.0)).alias("fraction_exceeding"),
    )
    return out if threshold is not None else out.drop("n_exceeding", "fraction_exceeding")


def side_facts(sides: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What the guards need of each side, both sides in one row per comparison."""
    def of(side: str, column: Column) -> Column:
        return F.when(F.col("side") == side, column)

    return sides.groupBy(*keys).agg(*[
        agg
        for s in ("A", "B")
        for agg in (
            F.max(of(s, F.trim(F.coalesce("variable", F.lit(""))))).alias(f"variable_{s}"),
            F.max(of(s, F.trim(F.coalesce("units", F.lit(""))))).alias(f"units_{s}"),
            F.count(of(s, finite("value"))).alias(f"n_{s}"),
            F.min(of(s, F.col("ts"))).alias(f"start_{s}"),
            F.max(of(s, F.col("ts"))).alias(f"end_{s}"),
        )
    ])


def disjoint_periods(sides: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether the two sides' time ranges do not even overlap."""
    disjoint = (F.col("end_A") < F.col("start_B")) | (F.col("end_B") < F.col("start_A"))
    return side_facts(sides, keys).select(
        *keys, "start_A", "end_A", "start_B", "end_B", F.coalesce(disjoint, F.lit(False)).alias("disjoint")
    )


def compare_guards(sides: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first reason to refuse a comparison, or NULL: variable, units, an empty side."""
    f = side_facts(sides, keys)
    va, vb = F.nullif("variable_A", F.lit("")), F.nullif("variable_B", F.lit(""))
    ua, ub = F.coalesce("units_A", F.lit("")), F.coalesce("units_B", F.lit(""))
    reason = (
        F.when(va != vb, "variable mismatch")
        .when((ua != "") & (ub != "") & (ua != ub), "units mismatch")
        .when((ua != "") != (ub != ""), "units missing on one side")
        .when(F.col("n_A") == 0, "no valid data for A")
        .when(F.col("n_B") == 0, "no valid data for B")
    )
    return f.select(*keys, reason.alias("refusal"))

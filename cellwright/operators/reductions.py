"""Reductions of masked cells over time and over space.

Masked cells carry `checked` (after fill and range) and `value` (after the flag); see
`masking.mask_cells`. `keys` are grouping columns such as a region or a panel: one plan serves all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.aggregates import values_stat, weighted_mean
from cellwright.functions.scalars import cos_weight, finite, is_finite, round6, sig7
from cellwright.operators import order_stats
from cellwright.operators.masking import in_range, is_fill, passes_qa
from cellwright.session import settle

CELL = ("i", "j", "lat", "lon")
CADENCE_UNIT = {"hourly": "hour", "daily": "day", "monthly": "month"}


def valid_timesteps(cells: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Timesteps with any finite value after masking."""
    return cells.where(is_finite(value)).select(*keys, "ts").distinct()


def cadence_weights(valid: DataFrame, cadence: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weight of each valid timestep: one over the valid timesteps in its hour, day or month.

    Works on the timestep table, one short row per granule, so a window per bucket is small even
    when one bucket holds most granules. Without a known cadence every timestep weighs the same.
    """
    unit = CADENCE_UNIT.get(cadence)
    if unit is None:
        return valid.withColumn("weight", F.lit(1.0))
    bucket = Window.partitionBy(*keys, F.date_trunc(unit, "ts"))
    return valid.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(bucket))


def _marked(cells: DataFrame) -> DataFrame:
    """Cells without any time are one timestep of their own, marked as such, beside all real ones."""
    epoch = F.lit("1970-01-01").cast(cells.schema["ts"].dataType)
    return cells.withColumns({"_undated": F.col("ts").isNull(), "ts": F.coalesce("ts", epoch)})


def _weighted(cells: DataFrame, cadence: str, keys: Sequence[str]) -> DataFrame:
    """Cells with the `weight` of their timestep, NULL where the timestep is not valid.

    The weights, one row per valid timestep, are written first, so that Spark knows their size: as long as they are small
    the cells meet them where they are read, and only sums per cell are shuffled.
    """
    marked, by = _marked(cells), [*keys, "_undated"]
    weights = settle(cadence_weights(valid_timesteps(marked, by), cadence, by), "weights")
    wanted = weights.select(*[F.col(c).alias(f"_w{c}") for c in [*by, "ts"]], "weight")
    same = F.lit(True)
    for c in [*by, "ts"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_w{c}"))
    return marked.join(wanted, same, "left").drop(*[f"_w{c}" for c in [*by, "ts"]])


def temporal_fields(
    cells: DataFrame, cadence: str, keys: Sequence[str] = (), stats: Sequence[str] = ("mean",), cell: Sequence[str] = CELL
) -> DataFrame:
    """Per-cell statistics over valid timesteps: one reading for the timesteps, one reading and one shuffle for the cells.

    An exact median keeps a cell's distinct values together, which its number of timesteps bounds; the other
    statistics are combined before the shuffle. A cell without a valid value stays, with NULLs.
    """
    v, w = F.when(F.col("weight").isNotNull(), F.col("value")), F.col("weight")
    aggs = {"mean": F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w))), "median": F.median(v), "max": F.max(v), "min": F.min(v), "std": F.stddev_samp(v)}
    return _weighted(cells, cadence, keys).groupBy(*keys, *cell).agg(*[aggs[s].alias(s) for s in stats])


def temporal_mean(cells: DataFrame, cadence: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cadence-weighted mean over time per cell, as `value`."""
    return temporal_fields(cells, cadence, keys).withColumnRenamed("mean", "value")


def temporal_stat(cells: DataFrame, stat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per-cell median, max, min or sample standard deviation over valid timesteps, as `value`."""
    if stat not in ("median", "max", "min", "std"):
        raise ValueError(f"Unsupported statistic '{stat}'. Valid: median, max, min, std")
    return temporal_fields(cells, "unknown", keys, [stat]).withColumnRenamed(stat, "value")


def area_weighted_mean(field: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return field.groupBy(*keys).agg(weighted_mean("value").alias("mean"))


def spatial_stats(field: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean, median, max, min and std over finite values of groups of any size."""
    v = "value"
    plain = field.groupBy(*keys).agg(
        *[values_stat(v, s).alias(s) for s in ("mean", "max", "min", "std")],
        F.count(F.when(is_finite(v), 1)).alias("n"),
    )
    return _with_median(plain, field, keys, v)


def _with_median(grouped: DataFrame, field: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    median = order_stats.quantiles(field, keys, value, {"median": 0.5}).drop("n")
    if keys:
        return grouped.join(median, list(keys), "left")
    return grouped.withColumn("median", median.select("median").scalar())


def regional_statistics(cells: DataFrame, cadence: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median, max, min, std and cell count of a region, each on the basis true to its name.

    Mean is area-weighted over the temporal-mean field; max and min run over every valid
    observation; median and std describe the temporal-mean field.
    """
    fields = settle(temporal_fields(cells, cadence, keys, ["mean", "max", "min"]), "fields")
    stats = fields.groupBy(*keys).agg(
        weighted_mean("mean").alias("mean"),
        F.max(finite("max")).alias("max"),
        F.min(finite("min")).alias("min"),
        F.stddev_samp(finite("mean")).alias("std"),
        F.count(F.when(is_finite("mean"), 1)).alias("n_pixels"),
    )
    return _with_median(stats, fields, keys, "mean").withColumns({
        "mean_basis": F.lit("mean over time per cell, then over the cells by their area"),
        "extreme_basis": F.lit("all valid observations"),
        "spread_basis": F.lit("mean over time per cell, then unweighted over the cells"),
    })


def find_peak(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest cell of the per-cell maximum field; the first in row-major order on ties."""
    field = temporal_fields(cells, "unknown", keys, ["max"])
    best = F.max(
        F.when(is_finite("max"), F.struct(F.col("max").alias("v"), (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"), "lat", "lon"))
    )
    return field.groupBy(*keys).agg(best.alias("_p")).select(
        *keys, F.col("_p.v").alias("peak_value"), F.col("_p.lat").alias("peak_lat"), F.col("_p.lon").alias("peak_lon")
    )


def regional_timeseries(cells: DataFrame, stat: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """One value per timestep that has data: the area-weighted mean, or an unweighted statistic."""
    by = [*keys, "ts"]
    if stat == "median":
        series = order_stats.quantiles(cells, by, "value", {"value": 0.5}).drop("n")
    else:
        value = weighted_mean("value") if stat == "mean" else values_stat("value", stat)
        series = cells.groupBy(*by).agg(value.alias("value"))
    return series.where(F.col("value").isNotNull()).select(*by, round6("value").alias("value")).orderBy(*by)


def field_statistics(field: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, valid fraction, area-weighted mean, min and max of the whole field, before thinning."""
    n = F.count(F.when(is_finite("value"), 1))
    v = finite("value")
    return field.groupBy(*keys).agg(
        n.alias("count"),
        F.round(F.coalesce(F.try_divide(n, F.count(F.lit(1))), F.lit(0.0)), 6).alias("valid_fraction"),
        sig7(F.coalesce(F.try_divide(F.sum(v * cos_weight("lat")), F.sum(F.when(v.isNotNull(), cos_weight("lat")))), F.avg(v))).alias("mean"),
        sig7(F.min(v)).alias("min"),
        sig7(F.max(v)).alias("max"),
    )


# --- Quality pass rate ----------------------------------------------------------------------------

def qa_counters(good, bad) -> dict[str, Column]:
    """Counter expressions over `checked`, `qa_flag` and `lat`, for batch and streaming groups."""
    checked = F.col("checked").isNotNull()
    passing = checked & passes_qa("qa_flag", good, bad)
    w = cos_weight("lat")
    return {
        "checked": F.count_if(checked),
        "passing": F.count_if(passing),
        "flag_missing": F.count_if(checked & F.col("qa_flag").isNull()),
        "pass_rate": F.round(F.try_divide(F.sum(F.when(passing, w).otherwise(F.when(checked, 0.0))), F.sum(F.when(checked, w))), 6),
    }


def qa_pass_rate(cells: DataFrame, keys: Sequence[str] = (), good=None, bad=None) -> DataFrame:
    """Pixels that had a value to check, those whose flag passed, and the area-weighted rate.

    Without a rule the mask did not run and there is no row; with nothing to check the rate is NULL.
    """
    if good is None and bad is None:
        return cells.groupBy(*keys).agg(*[c.alias(n) for n, c in qa_counters([], None).items()]).where(F.lit(False))
    return cells.groupBy(*keys).agg(*[c.alias(n) for n, c in qa_counters(good, bad).items()])


def qa_pass_rate_by_time(cells: DataFrame, keys: Sequence[str] = (), good=None, bad=None) -> DataFrame:
    return qa_pass_rate(cells, [*keys, "ts"], good, bad)


def counted_extent(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sizes of the dimensions the counters ran over."""
    return cells.groupBy(*keys).agg(
        F.count_distinct("ts").alias("n_time"), F.count_distinct("i").alias("n_lat"), F.count_distinct("j").alias("n_lon")
    )


# --- Labels and coverage --------------------------------------------------------------------------

def label_columns(cadence: str, stat: str) -> tuple[Column, Column]:
    """The label and the title suffix of a row with `n_granules` and the dates `_start` and `_end`."""
    n, start, end = F.col("n_granules"), F.col("_start").cast("string"), F.col("_end").cast("string")
    span = F.datediff("_end", "_start")
    differs = F.col("_start") != F.col("_end")
    date_range = F.when(differs, F.concat(start, F.lit(" to "), end)).otherwise(start)
    word = F.lit("granule") if cadence == "unknown" else F.lit(f"{cadence} granule")
    granules = F.concat(n.cast("string"), F.lit(" "), word, F.when(n == 1, "").otherwise("s"))
    period = F.when(n <= 1, "Single Snapshot")
    if cadence == "monthly":
        period = period.when((n == 12) & (span >= 300), "Annual")
    if cadence == "hourly":
        period = period.when((n >= 10) & (span <= 1), "Daily")
    period = F.coalesce(period.otherwise(date_range), F.lit("Single Snapshot"))
    year = F.when(F.year("_start") == F.year("_end"), F.year("_start").cast("string")).otherwise(date_range)
    label = stat.capitalize()
    return (F.concat_ws(", ", F.concat(period, F.lit(f" {label}")), granules, date_range),
            F.concat(period, F.lit(f" {label} ("), F.concat_ws(", ", year, granules), F.lit(")")))


def aggregation_label(valid: DataFrame, cadence: str, stat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Granule count, date range and the period word the dates justify."""
    facts = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_granules"),
        F.to_date(F.min("ts")).alias("_start"), F.to_date(F.max("ts")).alias("_end"),
    )
    label, suffix = label_columns(cadence, stat)
    return facts.select(
        *keys, "n_granules", F.col("_start").cast("string").alias("start_date"), F.col("_end").cast("string").alias("end_date"),
        label.alias("aggregation_label"), suffix.alias("title_suffix"),
    )


def variable_coverage(cells: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of cells that hold a value, per variable: aggregated wide first, then turned long."""
    wide = cells.groupBy(*keys).agg(*[F.avg(F.col(v).isNotNull().cast("double")).alias(v) for v in variables])
    return wide.unpivot(list(keys), list(variables), "variable", "valid_fraction")


def evidence_facts(
    cells: DataFrame, bands: Sequence[dict], cadence: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Area-weighted regional mean, coverage and share of the science mean per companion band.

    A band is `{name, role, units, fill, vmin, vmax}`. Its own fill and range are masked first, then
    its plain time mean is taken per cell, so it describes the same kind of field as the science map.
    """
    masked = cells
    for b in bands:
        c = F.col(b["name"])
        ok = in_range(c, b.get("vmin"), b.get("vmax"))
        if b.get("fill") is not None:
            ok = ok & ~F.coalesce(is_fill(cells, b["name"], b["fill"]), F.lit(False))
        masked = masked.withColumn(b["name"], F.when(ok, c))
    names = [b["name"] for b in bands]
    v, w = F.when(F.col("weight").isNotNull(), F.col("value")), F.col("weight")
    science = F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))
    field = _weighted(masked, cadence, keys).groupBy(*keys, *CELL).agg(science.alias("_science"), *[F.avg(n).alias(n) for n in names])
    wide = field.groupBy(*keys).agg(
        weighted_mean("_science").alias("_science"), F.count(F.lit(1)).alias("_cells"),
        *[F.struct(weighted_mean(n).alias("mean"), F.count(finite(n)).alias("n")).alias(n) for n in names],
    )
    facts = F.array(*[
        F.struct(
            F.lit(b["name"]).alias("name"), F.lit(b["role"]).alias("role"), F.lit(b.get("units", "")).alias("units"),
            F.col(b["name"]).alias("s"), F.lit("uncertainty" in b["name"].lower()).alias("uncertain"),
        )
        for b in bands
    ])
    long = wide.select(*keys, "_science", "_cells", F.explode(facts).alias("f")).where(F.col("f.s.mean").isNotNull())
    return long.select(
        *keys, F.col("f.name").alias("name"), F.col("f.role").alias("role"), F.lit("mean").alias("stat"),
        round6("f.s.mean").alias("value"), F.col("f.units").alias("units"),
        F.round(F.col("f.s.n") / F.col("_cells"), 4).alias("coverage"),
        F.when(F.col("f.uncertain") & (F.col("_science") != 0), F.round(F.abs(F.col("f.s.mean") / F.col("_science")), 4)).alias("pct_of_science"),
    )


def evidence_summary(charts: DataFrame, facts: DataFrame, keys: Sequence[str], known: Column | None = None) -> DataFrame:
    """The evidence each chart can be judged by, whether there is any, and the `reason` where there is none.

    `charts` holds one row per chart that was asked for with `keys`; `facts` come from `evidence_facts` over the same keys. `known`
    tells of a chart's row whether anything is known of how the chart was made; without it that is so for all.
    """
    listed = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.array_agg(F.struct("name", "role", "value", "units", "coverage", "pct_of_science"))).alias("evidence")
    )
    joined = charts.withColumn("_known", F.lit(True) if known is None else F.coalesce(known, F.lit(False))).join(listed, list(keys), "left")
    has = F.coalesce(F.col("_known") & (F.col("_n") > 0), F.lit(False))
    reason = F.when(~F.col("_known"), "nothing is recorded of this chart").when(~has, "no companion band with values was read for this chart")
    return joined.withColumns({"evidence": F.when(has, F.col("evidence")), "has_evidence": has, "reason": reason}).drop("_n", "_known")

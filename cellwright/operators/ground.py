"""Ground-monitor records: codes, filters, summaries, exceedances and monitor search.

Records carry a stable `record_no`, the order in which they were delivered; ties follow it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import float_or_none, haversine_miles, period_key, site_id
from cellwright.operators import order_stats
from cellwright.operators.regions import BOX_LADDER, MIN_BOX_HALF
from cellwright.session import settle

# --- Fixed values ---------------------------------------------------------------------------------
PLACEHOLDERS = [
    "", "site", "site_id", "site_number", "station_id", "monitor",
    "monitor_id", "unknown", "n/a", "na", "??",
]
# parameter code: standard, measured field, limit, units
REGULATORY_LIMITS = {
    "42602": ("NO2 1-hour 2010", "first_max_value", 100.0, "ppb"),
    "88101": ("PM25 24-hour 2024", "arithmetic_mean", 35.0, "µg/m³"),
    "44201": ("Ozone 8-hour 2015", "first_max_value", 70.0, "ppb"),
    "42401": ("SO2 1-hour 2010", "first_max_value", 75.0, "ppb"),
    "42101": ("CO 8-hour 1971", "first_max_value", 9.0, "ppm"),
}
# --------------------------------------------------------------------------------------------------

TILE_DEGREES = 1.0
#: A degree square with more places than DENSE is counted in SPLIT by SPLIT parts.
DENSE, SPLIT = 256, 16


def _column(df: DataFrame, name: str) -> Column:
    """A record field that some feeds do not have."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# --- Codes and filters ----------------------------------------------------------------------------

def normalize_site_codes(df: DataFrame) -> DataFrame:
    """Zero-padded state, county and site codes, or the reason to reject a row.

    A site given as `state-county-site` overrides the other two. Adds `reject_reason`.
    """
    site = F.trim(F.col("site_number").cast("string"))
    parts = F.split(site, "-")
    compound = F.instr(site, "-") > 0
    malformed = compound & (F.size(parts) != 3)
    out, reason = {}, F.when(malformed, F.lit("malformed station id"))
    for at, (name, width) in enumerate((("state_code", 2), ("county_code", 3), ("site_number", 4))):
        own = site if name == "site_number" else F.col(name).cast("string")
        text = F.trim(F.when(compound & ~malformed, F.get(parts, F.lit(at))).otherwise(own))
        reason = reason.when(text.isNull() | F.lower(text).isin(PLACEHOLDERS), F.lit(f"placeholder {name}"))
        reason = reason.when(~text.rlike(r"^\d+$"), F.lit(f"non-numeric {name}"))
        out[name] = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    marked = df.withColumns({**{f"_{n}": c for n, c in out.items()}, "reject_reason": reason})
    return marked.withColumns(
        {n: F.when(F.col("reject_reason").isNull(), F.col(f"_{n}")) for n in out}
    ).drop(*[f"_{n}" for n in out])


def ground_filter(
    records: DataFrame, *, state_code=None, county_code=None, site_number=None, cbsa_code=None, box=None
) -> DataFrame:
    """The most specific filter given: site, county, state, metropolitan area, or a full box."""
    pad = lambda v, w: str(v).strip().zfill(w)
    if site_number is not None and "-" in str(site_number):
        state_code, county_code, site_number = str(site_number).split("-")
    if state_code and county_code and site_number:
        wanted = {"state_code": pad(state_code, 2), "county_code": pad(county_code, 3), "site_number": pad(site_number, 4)}
    elif state_code and county_code:
        wanted = {"state_code": pad(state_code, 2), "county_code": pad(county_code, 3)}
    elif state_code:
        wanted = {"state_code": pad(state_code, 2)}
    elif cbsa_code:
        wanted = {"cbsa_code": str(cbsa_code).strip()}
    elif box is not None and all(b is not None for b in box):
        south, north, west, east = map(float, box)
        return records.where(
            float_or_none("latitude").between(south, north) & float_or_none("longitude").between(west, east)
        )
    else:
        raise ValueError("Give a site, a county, a state, a metropolitan area, or all four box bounds.")
    for name, value in wanted.items():
        if not value.isdigit():
            raise ValueError(f"Invalid {name}: {value!r} must contain digits only.")
        records = records.where(F.col(name) == value)
    return records


def filter_standard(records: DataFrame, standard: str | None) -> DataFrame:
    return records if standard is None else records.where(F.col("pollutant_standard") == standard)


def list_states(monitors: DataFrame) -> DataFrame:
    return monitors.select("state_code").distinct()


def sample_rows(samples: DataFrame) -> DataFrame:
    """Hourly readings as result rows, by site and time."""
    time = F.coalesce("time_local", F.lit(""))
    return samples.select(
        site_id().alias("site_id"),
        F.concat(F.coalesce("date_local", F.lit("")), F.lit(" "), time).alias("datetime_local"),
        F.col("date_local").alias("date"), F.substring_index("time_local", ":", 1).try_cast("int").alias("hour"),
        F.col("sample_measurement").alias("value"), F.col("units_of_measure").alias("units"),
        "sample_duration", "qualifier", "method", "local_site_name",
    ).orderBy("site_id", "datetime_local")


# --- Summaries ------------------------------------------------------------------------------------

def peak_value(records: DataFrame, period: str) -> Column:
    own = float_or_none(_column(records, "first_max_value")) if period == "daily" else F.lit(None).cast("double")
    return F.coalesce(own, float_or_none(_column(records, "maximum_value")), float_or_none(_column(records, "arithmetic_mean")))


def first_sites(records: DataFrame, cap: int) -> DataFrame:
    """The first `cap` site ids in sort order: each task keeps its own first ones."""
    return records.select(site_id().alias("site_id")).distinct().orderBy("site_id").limit(cap)


def site_cap(records: DataFrame, cap: int) -> DataFrame:
    """Every site id, and whether it is `within` the first `cap` in sort order."""
    sites = records.select(site_id().alias("site_id")).distinct()
    return sites.join(first_sites(records, cap).withColumn("within", F.lit(True)), "site_id", "left").withColumn("within", F.coalesce("within", F.lit(False)))


def peak_record(records: DataFrame, period: str, keys: Sequence[str] = ("site_id", "period")) -> DataFrame:
    """The record with the highest value per site and period; the first one wins ties."""
    rows = records.withColumns({"site_id": site_id(), "period": period_key(period), "_v": peak_value(records, period)})
    best = F.max(F.when(F.col("_v").isNotNull(), F.struct(
        F.col("_v").alias("value"), (-F.col("record_no")).alias("no"),
        _column(records, "date_local").cast("string").alias("date"), _column(records, "first_max_hour").cast("string").alias("hour"),
    )))
    return rows.groupBy(*keys).agg(best.alias("_p")).select(
        *keys, F.col("_p.value").alias("peak_value"), (-F.col("_p.no")).alias("peak_record_no"),
        F.col("_p.date").alias("peak_date"), F.col("_p.hour").alias("peak_hour"),
    )


def ground_summary(records: DataFrame, period: str, cap: int | None = None) -> DataFrame:
    """One row per site and period from the feed's own statistics.

    Minimum and maximum never come from the mean. All sites are reported unless the caller
    gives a `cap`; see `summary_totals` for the totals before it.
    """
    rows = records.withColumns({"site_id": site_id(), "period": period_key(period)})
    if cap is not None:
        # At most `cap` short rows.
        rows = rows.join(F.broadcast(first_sites(records, cap)), "site_id", "left_semi")
    number = lambda name: float_or_none(_column(records, name))
    top = F.when(_column(records, "maximum_value").isNotNull(), number("maximum_value")).otherwise(number("first_max_value"))
    rows = rows.withColumns({
        "_mean": number("arithmetic_mean"), "_min": number("minimum_value"), "_max": top, "_peak": peak_value(records, period),
        "_obs": number("observation_count"), "_pct": number("observation_percent"),
        "_valid": number("valid_day_count"), "_required": number("required_day_count"),
    })
    described = ["local_site_name", "units_of_measure", "pollutant_standard", "sample_duration"]
    out = rows.groupBy("site_id", "period").agg(
        F.min(F.struct("record_no", *[_column(records, c).alias(c) for c in described])).alias("_first"),
        F.count(F.lit(1)).alias("n_periods"),
        F.round(F.avg("_mean"), 6).alias("mean"), F.min("_min").alias("min"), F.max("_max").alias("max"),
        F.max("_peak").alias("peak_value"),
        F.max(F.when(F.col("_peak").isNotNull(), F.struct(
            F.col("_peak").alias("v"), (-F.col("record_no")).alias("no"),
            _column(records, "first_max_hour").cast("string").alias("hour"),
        ))).alias("_p"),
        F.floor(F.sum("_obs")).alias("observation_count"), F.round(F.avg("_pct"), 6).alias("observation_percent"),
        F.floor(F.sum("_valid")).alias("valid_day_count"), F.floor(F.sum("_required")).alias("required_day_count"),
    )
    return out.select(
        "site_id", "period", F.col("_first.local_site_name").alias("local_site_name"),
        F.col("_first.units_of_measure").alias("units"), F.col("_first.pollutant_standard").alias("pollutant_standard"),
        F.col("_first.sample_duration").alias("sample_duration"), "n_periods", "mean", "min", "max", "peak_value",
        F.col("_p.hour").alias("peak_hour"), "observation_count", "observation_percent", "valid_day_count", "required_day_count",
    )


def summary_totals(records: DataFrame, period: str, cap: int | None = None) -> DataFrame:
    """Sites and periods matched, and sites returned: all of them, but for a `cap` that the caller gives."""
    groups = records.select(site_id().alias("site_id"), period_key(period).alias("period")).distinct()
    per_site = groups.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    return per_site.groupBy().agg(
        F.count(F.lit(1)).alias("total_sites_matched"),
        (F.count(F.lit(1)) if cap is None else F.least(F.count(F.lit(1)), F.lit(cap))).alias("sites_returned"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_periods_matched"),
    )


# --- Exceedances ----------------------------------------------------------------------------------

def percentile_cutoff(records: DataFrame, field: str, percentile: float, keys: Sequence[str] = ()) -> DataFrame:
    """The value at 0-based position min(n * p / 100, n - 1) of the sorted values, as `cutoff`."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be between 0 and 100.")
    at = lambda n: F.least(F.floor(n * F.lit(float(percentile)) / 100), n - 1)
    rows = records.withColumn("_v", float_or_none(field))
    return order_stats.values_at(rows, keys, "_v", {"cutoff": at})


def exceedance_days(
    records: DataFrame, field: str = "first_max_value", hard: float | None = None, percentile: float | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Records over a fixed limit and/or at or above the cutoff of all matched records, by date, with the feed's own index.

    The date window has the bounds that are given, inclusive. `exceedance_facts` tells what was matched and applied.
    """
    if hard is None and percentile is None:
        raise ValueError("Give at least one of: hard, percentile.")
    rows = _matched(records, field, start, end).where(F.col("value").isNotNull())
    over = F.lit(None).cast("string")
    if hard is not None:
        over = F.when(F.col("value") > hard, F.lit("hard"))
    top = F.lit(None).cast("string")
    if percentile is not None:
        cutoff = percentile_cutoff(rows, "value", percentile).select("cutoff").scalar()
        top = F.when(F.col("value") >= cutoff, F.lit("percentile"))
    rows = rows.withColumn("triggered", F.array_compact(F.array(over, top))).where(F.size("triggered") > 0)
    return rows.select(
        F.col("date_local").alias("date"), site_id().alias("site_id"), "value", float_or_none(_column(records, "aqi")).alias("aqi"), "triggered", "local_site_name"
    ).orderBy("date", "site_id")


def exceedance_facts(
    records: DataFrame, field: str = "first_max_value", hard: float | None = None, percentile: float | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """One row beside `exceedance_days` of the same arguments: the limits applied, the records matched, those with a value, and the dates and sites they span."""
    rows = _matched(records, field, start, end)
    facts = rows.groupBy().agg(
        F.count(F.lit(1)).alias("records_matched"), F.count("value").alias("records_with_value"), F.count_distinct("date_local").alias("dates_matched"),
        F.count_distinct(site_id()).alias("sites_matched"), F.min("date_local").alias("first_date"), F.max("date_local").alias("last_date"))
    cutoff = F.lit(None).cast("double") if percentile is None else percentile_cutoff(rows, "value", percentile).select("cutoff").scalar()
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    return facts.select(F.lit(field).alias("field"), number(hard).alias("hard"), number(percentile).alias("percentile"), cutoff.alias("cutoff"), *facts.columns)


def _matched(records: DataFrame, field: str, start: str | None, end: str | None) -> DataFrame:
    """The records of the date window with the measured field as `value`."""
    rows = records.withColumn("_date", F.to_date("date_local"))
    if start is not None:
        rows = rows.where(F.col("_date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("_date") <= F.to_date(F.lit(end)))
    return rows.withColumn("value", float_or_none(field))


def regulatory_rule(param_code: str, hard: float | None = None, percentile: float | None = None) -> dict:
    """Standard, measured field and limit of a parameter; an explicit limit wins over the regulatory one."""
    standard, field, limit, _ = REGULATORY_LIMITS.get(param_code, (None, "first_max_value", None, None))
    hard = hard if hard is not None else limit
    if hard is None and percentile is None:
        raise ValueError(f"No regulatory threshold known for '{param_code}'. Give a limit or a percentile.")
    return {"standard": standard, "field": field, "hard": hard}


def exceedance_report(
    records: DataFrame, param_code: str, hard: float | None = None, percentile: float | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Exceedance days of one parameter under its own standard, field and limit."""
    rule = regulatory_rule(param_code, hard, percentile)
    return exceedance_days(filter_standard(records, rule["standard"]), rule["field"], rule["hard"], percentile, start, end)


def exceedance_dates(
    records: DataFrame, field: str = "first_max_value", hard: float | None = None, percentile: float | None = None
) -> DataFrame:
    """Distinct exceeding dates per site; the cutoff is each site's own."""
    rows = records.select(site_id().alias("site_id"), F.col("date_local").alias("date"), float_or_none(field).alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    hit = F.lit(False) if hard is None else F.col("value") > hard
    if percentile is not None:
        cutoffs = percentile_cutoff(rows, "value", percentile, ["site_id"]).select("site_id", "cutoff")
        rows = rows.join(cutoffs, "site_id")
        hit = hit | (F.col("value") >= F.col("cutoff"))
    return rows.where(hit).select("site_id", "date").distinct()


# --- Monitor search -------------------------------------------------------------------------------

def _tiles(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / TILE_DEGREES).cast("int"), F.floor(hi / TILE_DEGREES).cast("int")))


def located(monitors: DataFrame) -> DataFrame:
    return monitors.withColumns({"_lat": float_or_none("latitude"), "_lon": float_or_none("longitude")})


def first_step(south: Column, north: Column, west: Column, east: Column) -> Column:
    """First step of the ladder whose box holds the place (`_lat`, `_lon`); NULL when none does."""
    step = F.lit(None).cast("int")
    for n in reversed(range(len(BOX_LADDER))):
        d = BOX_LADDER[n]
        held = F.col("_lat").between(south - d, north + d) & F.col("_lon").between(west - d, east + d)
        step = F.when(held, F.lit(n)).otherwise(step)
    return step


def step_counts(n: Column) -> list[Column]:
    """Monitors held by each step's box, from `_step` and the monitors a row stands for."""
    return [F.sum(F.when(F.col("_step") <= s, n).otherwise(0)).alias(f"_s{s}") for s in range(len(BOX_LADDER))]


def chosen_step(k: int) -> Column:
    """The first step with at least `k` monitors, else the first that holds as many as the widest."""
    steps = range(len(BOX_LADDER))
    return F.coalesce(
        *[F.when(F.col(f"_s{s}") >= k, F.lit(s)) for s in steps],
        *[F.when(F.col(f"_s{s}") == F.col(f"_s{len(BOX_LADDER) - 1}"), F.lit(s)) for s in steps],
    )


def _spots(monitors: DataFrame) -> DataFrame:
    """Places with their number of monitors and the tile they are counted in: a degree square, or an eighth of one where places are dense."""
    places = located(monitors).where(F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).groupBy("_lat", "_lon").agg(F.count(F.lit(1)).alias("_n"))
    places = places.withColumns({
        "_ty": F.floor(F.col("_lat") / TILE_DEGREES).cast("int"), "_tx": F.floor(F.col("_lon") / TILE_DEGREES).cast("int"),
        "_py": F.floor(F.col("_lat") / TILE_DEGREES * SPLIT).cast("int"), "_px": F.floor(F.col("_lon") / TILE_DEGREES * SPLIT).cast("int"),
    })
    crowded = places.groupBy("_ty", "_tx").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > DENSE).select("_ty", "_tx", F.lit(True).alias("_dense"))
    # parts of a tile that is not dense are one tile
    whole = F.lit(None).cast("int")
    return settle(places.join(crowded, ["_ty", "_tx"], "left").withColumns(
        {c: F.coalesce(F.when(F.col("_dense"), F.col(c)).otherwise(whole), F.lit(-(1 << 30))) for c in ("_py", "_px")}).drop("_dense"), "spots")


_TILE = ["_ty", "_tx", "_py", "_px"]
_EDGES = ["south", "north", "west", "east"]


def _reached(boxes: DataFrame, tiles: DataFrame, width: Column) -> DataFrame:
    """Boxes beside the tiles that they touch when widened by `width`; they meet on degree squares."""
    rows = boxes.withColumn("_ty", _tiles(F.col("south") - width, F.col("north") + width))
    rows = rows.withColumn("_tx", _tiles(F.col("west") - width, F.col("east") + width))
    return rows.join(tiles, ["_ty", "_tx"]).where(_touches(width))


def _touches(d: Column) -> Column:
    return ((F.col("_n_lat") >= F.col("south") - d) & (F.col("_s_lat") <= F.col("north") + d) & (F.col("_e_lon") >= F.col("west") - d) & (F.col("_w_lon") <= F.col("east") + d))


def _holds(d: Column) -> Column:
    return ((F.col("_s_lat") >= F.col("south") - d) & (F.col("_n_lat") <= F.col("north") + d) & (F.col("_w_lon") >= F.col("west") - d) & (F.col("_e_lon") <= F.col("east") + d))


def search_steps(boxes: DataFrame, spots: DataFrame, k: int) -> DataFrame:
    """The step of the ladder that each distinct box stops at.

    Steps are settled by counts of tiles: a step surely holds the monitors of the tiles inside its box and no others than those of
    the tiles that it touches. Only boxes that this leaves open are counted place by place.
    """
    tiles = spots.groupBy(*_TILE).agg(
        F.sum("_n").alias("_m"), F.min("_lat").alias("_s_lat"), F.max("_lat").alias("_n_lat"), F.min("_lon").alias("_w_lon"), F.max("_lon").alias("_e_lon"))
    ladder = [F.lit(float(d)) for d in BOX_LADDER]
    sought = boxes.select(*_EDGES).distinct()
    near = _reached(sought, tiles, ladder[-1])
    sums = near.groupBy(*_EDGES).agg(
        *[F.sum(F.when(_holds(d), F.col("_m")).otherwise(0)).alias(f"_low{n}") for n, d in enumerate(ladder)],
        *[F.sum(F.when(_touches(d), F.col("_m")).otherwise(0)).alias(f"_high{n}") for n, d in enumerate(ladder)])
    first = lambda side: F.coalesce(*[F.when(F.col(f"_{side}{n}") >= k, F.lit(n)) for n in range(len(ladder))])
    sums = settle(sums.select(*_EDGES, first("low").alias("_sure"), first("high").alias("_may")), "steps")
    decided = sums.where(F.col("_sure") == F.col("_may")).select(*_EDGES, F.col("_sure").alias("step"))
    unsure = sums.where(F.coalesce(F.col("_sure") != F.col("_may"), F.lit(True))).select(*_EDGES)
    open_tiles = _reached(unsure, tiles, ladder[-1])
    inner = open_tiles.where(_holds(ladder[0])).select(*_EDGES, F.lit(0).alias("_step"), F.col("_m").alias("_n"))
    outer = open_tiles.where(~_holds(ladder[0])).select(*_EDGES, *_TILE).join(spots, _TILE)
    outer = outer.withColumn("_step", first_step(F.col("south"), F.col("north"), F.col("west"), F.col("east"))).select(*_EDGES, "_step", "_n").where(F.col("_step").isNotNull())
    counted = inner.unionByName(outer).groupBy(*_EDGES).agg(*step_counts(F.col("_n"))).select(*_EDGES, chosen_step(k).alias("step"))
    return decided.unionByName(counted)


def monitor_search(boxes: DataFrame, monitors: DataFrame, k: int = 1) -> DataFrame:
    """Monitors of the first ladder box that holds at least `k`; the fullest box when none does.

    `boxes` holds (query_id, south, north, west, east). Equal boxes are searched once and monitors
    at one place count as one row until the end. The step comes from counts (`search_steps`); only then do boxes meet
    places, those of the chosen step, tile by tile, and a crowded tile in parts. Returns (query_id, step, monitor columns).
    """
    spots = _spots(monitors)
    steps = search_steps(boxes, spots, k)
    width = F.element_at(F.array(*[F.lit(float(d)) for d in BOX_LADDER]), F.col("step") + 1)
    tiles = spots.groupBy(*_TILE).agg(F.min("_lat").alias("_s_lat"), F.max("_lat").alias("_n_lat"), F.min("_lon").alias("_w_lon"), F.max("_lon").alias("_e_lon"))
    near = _reached(steps, tiles, width).select(*_EDGES, "step", *_TILE).join(spots, _TILE)
    held = F.col("_lat").between(F.col("south") - width, F.col("north") + width) & F.col("_lon").between(F.col("west") - width, F.col("east") + width)
    found = near.where(held).select(*_EDGES, "step", "_lat", "_lon")
    return (
        boxes.select("query_id", *_EDGES).join(found, _EDGES)
        .join(located(monitors), ["_lat", "_lon"])
        .drop(*_EDGES)
    )


def nearest_monitors(points: DataFrame, monitors: DataFrame, k: int) -> DataFrame:
    """The `k` nearest monitors of each point (query_id, lat, lon) among those its search finds.

    The rank filter lets Spark keep the best `k` per point in every task before the shuffle.
    """
    half = F.lit(MIN_BOX_HALF)
    boxes = points.select(
        "query_id", (F.col("lat") - half).alias("south"), (F.col("lat") + half).alias("north"),
        (F.col("lon") - half).alias("west"), (F.col("lon") + half).alias("east"),
    )
    found = monitor_search(boxes, monitors, k).join(points.select("query_id", "lat", "lon"), "query_id")
    far = found.withColumns({"_d": haversine_miles("lat", "lon", "_lat", "_lon"), "station_id": site_id()})
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_d", "station_id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "station_id", F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        F.round("_d", 3).alias("distance_miles"),
    )

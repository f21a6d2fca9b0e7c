"""Operators as SQL table functions over temporary views.

`install` registers functions of the session over the views it is given; the optimizer inlines them, so they plan and push down
like the same SQL written out. They say what the Python operators say, which tests hold against each other.

    install(spark, cells="masked_cells", monitors="monitors")
    SELECT * FROM regional_timeseries('mean', -115, 24, -90, 44) WHERE ts >= '2024-01-01'
    SELECT * FROM qa_pass_rate(array(0), NULL, -115, 24, -90, 44)
    SELECT p.name, m.* FROM places p, LATERAL nearest_monitors(p.lat, p.lon, 3) m

Cells have the columns of `masking.mask_cells`: `checked`, `value`, `qa_flag`, `ts`, `lat`, `lon`. NULL bounds do not narrow. A function is
bound to the views' names: what they show when it is called counts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cellwright.operators.ground import BOX_LADDER, MIN_BOX_HALF
from cellwright.functions.scalars import EARTH_RADIUS_MILES

_BOX = "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE"
_WITHIN = ("(west IS NULL OR lon >= west) AND (east IS NULL OR lon <= east) AND (south IS NULL OR lat >= south) AND (north IS NULL OR lat <= north)")
_WEIGHT = "greatest(cos(radians(lat)), 0D)"
_FINITE = "value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')"

_SERIES = f"""
SELECT ts, round(v, 6) AS value FROM (
  SELECT ts, CASE stat
    WHEN 'mean' THEN CASE WHEN max(CASE WHEN {_FINITE} THEN 1 END) = 1 THEN try_divide(sum({_WEIGHT} * value), sum(CASE WHEN value IS NOT NULL THEN {_WEIGHT} END)) END
    WHEN 'median' THEN median(CASE WHEN {_FINITE} THEN value END) WHEN 'max' THEN max(CASE WHEN {_FINITE} THEN value END)
    WHEN 'min' THEN min(CASE WHEN {_FINITE} THEN value END) WHEN 'std' THEN stddev_samp(CASE WHEN {_FINITE} THEN value END)
    ELSE raise_error(concat('unknown statistic ', stat)) END AS v
  FROM {{cells}} WHERE {_WITHIN} GROUP BY ts)
WHERE v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')"""

_PASS = f"""
SELECT count_if(checked IS NOT NULL) AS checked, count_if(passes) AS passing, count_if(checked IS NOT NULL AND qa_flag IS NULL) AS flag_missing,
  round(try_divide(sum(CASE WHEN passes THEN {_WEIGHT} WHEN checked IS NOT NULL THEN 0D END), sum(CASE WHEN checked IS NOT NULL THEN {_WEIGHT} END)), 6) AS pass_rate
FROM (SELECT *, checked IS NOT NULL AND qa_flag IS NOT NULL AND coalesce(CASE WHEN good IS NOT NULL THEN array_contains(good, int(qa_flag)) ELSE NOT array_contains(bad, int(qa_flag)) END, false) AS passes
      FROM {{cells}} WHERE {_WITHIN}) HAVING good IS NOT NULL OR bad IS NOT NULL"""


def _first_step() -> str:
    """The first box of the ladder around a point that holds a monitor."""
    held = [f"WHEN abs(mlat - at_lat) <= {MIN_BOX_HALF + d}D AND abs(mlon - at_lon) <= {MIN_BOX_HALF + d}D THEN {n}" for n, d in enumerate(BOX_LADDER)]
    return f"CASE {' '.join(held)} END"


_NUMBER = "try_cast(nullif(trim({0}), '') AS DOUBLE)"
_SITE = "concat_ws('-', state_code, county_code, site_number)"
_LAST = len(BOX_LADDER) - 1
_CHOSEN = "coalesce(" + ", ".join(
    [f"CASE WHEN count_if(step <= {n}) OVER () >= k THEN {n} END" for n in range(_LAST + 1)]
    + [f"CASE WHEN count_if(step <= {n}) OVER () = count_if(step <= {_LAST}) OVER () THEN {n} END" for n in range(_LAST + 1)]) + ")"

_MONITORS = f"""
SELECT int(rank) AS rank, station_id, latitude, longitude, round(d, 3) AS distance_miles FROM (
  SELECT station_id, mlat AS latitude, mlon AS longitude, d, row_number() OVER (ORDER BY d, station_id) AS rank FROM (
    SELECT *, {_CHOSEN} AS chosen FROM (
      SELECT *, {_first_step()} AS step, {2 * EARTH_RADIUS_MILES}D * asin(sqrt(least(1D, pow(sin(radians(mlat - at_lat) / 2), 2)
        + cos(radians(at_lat)) * cos(radians(mlat)) * pow(sin(radians(mlon - at_lon) / 2), 2)))) AS d
      FROM (SELECT {_SITE} AS station_id, {_NUMBER.format('latitude')} AS mlat, {_NUMBER.format('longitude')} AS mlon FROM {{monitors}}
            WHERE abs({_NUMBER.format('latitude')} - at_lat) <= {MIN_BOX_HALF + BOX_LADDER[-1]}D AND abs({_NUMBER.format('longitude')} - at_lon) <= {MIN_BOX_HALF + BOX_LADDER[-1]}D)))
  WHERE step <= chosen) WHERE rank <= k"""

#: name: arguments, result, text over the views
FUNCTIONS = {
    "regional_timeseries": (f"stat STRING, {_BOX}", "ts TIMESTAMP, value DOUBLE", _SERIES),
    "qa_pass_rate": (f"good ARRAY<INT>, bad ARRAY<INT>, {_BOX}", "checked BIGINT, passing BIGINT, flag_missing BIGINT, pass_rate DOUBLE", _PASS),
    "nearest_monitors": ("at_lat DOUBLE, at_lon DOUBLE, k INT", "rank INT, station_id STRING, latitude DOUBLE, longitude DOUBLE, distance_miles DOUBLE", _MONITORS),
}


def install(spark: SparkSession, cells: str | None = None, monitors: str | None = None, prefix: str = "") -> list[str]:
    """Register the functions whose view is named; returns their names, each with `prefix` before it."""
    views = {"cells": cells, "monitors": monitors}
    made = []
    for name, (arguments, result, text) in FUNCTIONS.items():
        needed = [v for v in views if f"{{{v}}}" in text]
        if all(views[v] for v in needed):
            body = text.format(**{v: views[v] for v in needed})
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({result}) RETURN {body}")
            made.append(prefix + name)
    return made

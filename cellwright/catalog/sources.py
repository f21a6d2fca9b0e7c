"""Registered queries: readers, granules, named regions and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import BOXES, IN_A, IN_B, MASKED, REGIONED, TEMPORAL_MEAN, W, as_text, masked_cells, masked_hourly, r6, MASKED_HOURLY
from cellwright.catalog.fixtures import ctes, fixture
from cellwright.operators import reductions as D
from cellwright.operators import regions as R
from cellwright.session import fresh_path
from cellwright.sources import cells as S
from cellwright.sources import exports as X
from cellwright.sources import places as P
from cellwright.sources import records as Q
from cellwright.sources import survey as V


def _stored_cells(s, d):
    """The fixture grid in the core schema, with NaN for every fill as decoders leave it."""
    c = fixture(s, d, "fx_cells")
    return c.select(
        "collection", "granule_id", F.col("ts").cast("timestamp").alias("ts"), "i", "j", "lat", "lon", F.lit(None).cast("double").alias("level"),
        F.when(F.col("raw_value") == -999, F.lit(float("nan"))).otherwise(F.col("raw_value")).alias("value"), "qa_flag", "cloud_fraction",
    )


def _scan_cells(s, d):
    path = fresh_path(s, "cells")
    _stored_cells(s, d).write.parquet(path)
    out = S.scan_cells(s, path, ["cloud_fraction"], box=BOXES["A"], start="1996-01-01", end="2000-01-01")
    return out.select("granule_id", "i", "j", "value", "qa_flag", "cloud_fraction")


def _write_cube(s, d):
    path = fresh_path(s, "cube")
    S.write_cube(_stored_cells(s, d), path, tile=32)
    return S.scan_cube(s, path, BOXES["B"]).select("collection", "granule_id", "i", "j", "value")


def _append_cube(s, d):
    """Years of cells appended one after the other, one of them twice and one under another name, then read back with their survey."""
    path = fresh_path(s, "cube")
    cells = _stored_cells(s, d)
    for batch, (first, last) in {"a": (1990, 1994), "b": (1995, 1996), "c": (1997, 2100)}.items():
        S.write_cube(cells.where(F.year("ts").between(first, last)), path, tile=32, batch=batch)
    S.write_cube(cells.where("year(ts) BETWEEN 1995 AND 1996"), path, batch="b")
    S.write_cube(cells.where("year(ts) BETWEEN 1996 AND 1997"), path, batch="d")
    steps = V.timesteps(S.cube_survey(s, path)).agg(F.count("*")).scalar()
    return S.scan_cube(s, path, BOXES["A"], start="1994-06-01").groupBy("granule_id").agg(
        F.count("*").alias("cells"), F.count("value").alias("valid"), F.round(F.max("value"), 6).alias("top")).withColumn("timesteps", steps)


def _survey(s, d):
    found = V.survey(fixture(s, d, "fx_cells"), 32)
    tiles = V.tiles(found).select(F.concat(F.lit("tile "), "tile_i", F.lit(" "), "tile_j").alias("what"), F.col("lat_lo").alias("low"), F.col("lon_hi").alias("high"), "cells")
    named = V.granules(found).select(F.concat(F.lit("granule "), "granule_id").alias("what"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "cells")
    axes = [V.centers(found, c).agg(F.lit(c).alias("what"), F.min(c).alias("low"), F.max(c).alias("high"), F.count("*").alias("cells")) for c in ("lat", "lon")]
    return tiles.unionByName(named).unionByName(axes[0]).unionByName(axes[1])


def _scan_ground(s, d):
    path = fresh_path(s, "samples")
    fixture(s, d, "fx_samples").drop("record_no").write.json(path)
    return Q.scan_ground_records(s, path, "samples")


def _attrs(s, d):
    """Granule attributes of every order: some with a time, some dated by attributes, some unreadable."""
    n = F.col("o_orderkey") % 7
    day = F.to_date("o_orderdate").cast("string")
    return fixture(s, d, "orders").select(
        "o_orderkey", F.when(n < 2, F.col("o_orderdate")).alias("ts"),
        F.when(n == 3, "no date").when(n == 4, F.concat(day, F.lit("T05:00:00"))).when(n != 5, day).alias("range_beginning_date"),
        F.when(n == 2, "06:30:00Z").when(n == 6, "12:00:00.000Z").when(n == 0, "").alias("range_beginning_time"),
        F.when(n != 6, day).alias("range_ending_date"), F.lit("23:59:59Z").alias("range_ending_time"),
        F.when(n == 1, F.concat(day, F.lit("T01:02:03Z"))).alias("time_coverage_start"), F.lit(None).cast("string").alias("time_coverage_end"),
    )


_ATTRS = """SELECT o_orderkey, CASE WHEN n < 2 THEN o_orderdate END AS ts, CASE n WHEN 3 THEN 'no date' WHEN 4 THEN concat(day, 'T05:00:00') WHEN 5 THEN NULL ELSE day END AS bd,
  CASE n WHEN 2 THEN '06:30:00Z' WHEN 6 THEN '12:00:00.000Z' WHEN 0 THEN '' END AS bt, CASE WHEN n <> 6 THEN day END AS ed, '23:59:59Z' AS et, CASE WHEN n = 1 THEN concat(day, 'T01:02:03Z') END AS cs
  FROM (SELECT *, o_orderkey % 7 AS n, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders)"""


def _concat(s, d):
    c = fixture(s, d, "fx_granule_cells")
    first = c.where("collection = 'F'").select("granule_id", "i", "j", "value")
    second = c.where("collection <> 'F'").select("granule_id", "i", "j", F.col("lat").alias("band"), "value")
    return S.concat_granules(first, second).groupBy("granule_id").agg(F.count("*").alias("n"), F.count("band").alias("n_band"), F.round(F.max("value"), 6).alias("top"))


def _field(s, d):
    return D.temporal_mean(R.with_regions(masked_cells(s, d), BOXES), "monthly", ["region_id"])


def _export_cells(s, d):
    path = fresh_path(s, "csv")
    X.write_csv(X.cells_table(_field(s, d), "price", "usd", "region_id"), path, ["panel", "latitude", "longitude"])
    back = s.read.schema("panel string, variable string, latitude double, longitude double, value double, units string").csv(path, header=True)
    return r6(back, "value")


def _export_wide(s, d):
    path = fresh_path(s, "csv")
    cells = masked_hourly(s, d)
    X.write_csv(X.granule_table(cells, D.temporal_mean(cells, "hourly"), "reading", "ppb"), path)
    back = s.read.schema("variable string, latitude double, longitude double, header string, value double, units string").csv(path, header=True)
    return r6(back, "value")


def _export_series(s, d):
    path = fresh_path(s, "csv")
    series = D.regional_timeseries(R.crop_bounds(masked_cells(s, d), BOXES["A"]))
    X.write_csv(X.series_table(series, "price", "mean", "usd"), path, ["time"])
    return s.read.schema("variable string, time string, stat string, value double, units string").csv(path, header=True)


def _places(s, d):
    """Every customer's region name, spelled in three ways, with the box it stands for."""
    r = fixture(s, d, "customer").join(fixture(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(fixture(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("c_custkey") % 3
    named = r.select("c_custkey", F.when(n == 0, F.concat(F.lit("The  "), F.replace("r_name", F.lit(" "), F.lit("   ")))).when(n == 1, F.initcap(F.lower("r_name"))).otherwise(F.col("r_name")).alias("place"))
    return P.resolve_places(named, P.load_regions(s)).groupBy("region_id", "name", "region_type", "minx", "miny", "maxx", "maxy").agg(F.count("*").alias("n"))


_PLACES = """(VALUES ('africa', 'Africa', -18.0::DOUBLE, -35.0::DOUBLE, 52.0::DOUBLE, 38.0::DOUBLE), ('asia', 'Asia', 26, -10, 180, 78), ('europe', 'Europe', -25, 34, 45, 72), ('middle east', 'Middle East', 26, 12, 63, 42)) p(region_id, name, minx, miny, maxx, maxy)"""

QUERIES = {
    "scan_cells": (
        _scan_cells,
        ctes("fx_cells") + f"""SELECT granule_id, i, j, nullif(raw_value, -999) AS value, qa_flag, cloud_fraction FROM fx_cells WHERE {IN_A} AND ts >= DATE '1996-01-01' AND ts < DATE '2000-01-01'""",
    ),
    "write_cube": (
        _write_cube,
        ctes("fx_cells") + f"SELECT collection, granule_id, i, j, nullif(raw_value, -999) AS value FROM fx_cells WHERE {IN_B}",
    ),
    "append_cube": (
        _append_cube,
        ctes("fx_cells") + f"""SELECT granule_id, count(*) AS cells, count(nullif(raw_value, -999)) AS valid, round(max(nullif(raw_value, -999)), 6) AS top,
        (SELECT count(DISTINCT ts) FROM fx_cells) AS timesteps FROM fx_cells WHERE {IN_A} AND ts >= DATE '1994-06-01' GROUP BY granule_id""",
    ),
    "survey": (
        _survey,
        ctes("fx_cells") + """SELECT concat('tile ', CAST(floor(i / 32) AS INT), ' ', CAST(floor(j / 32) AS INT)) AS what, min(lat) AS low, max(lon) AS high, count(*) AS cells FROM fx_cells GROUP BY 1
        UNION ALL SELECT concat('granule ', granule_id), NULL, NULL, count(*) FROM fx_cells GROUP BY granule_id
        UNION ALL SELECT 'lat', min(lat), max(lat), count(DISTINCT lat) FROM fx_cells UNION ALL SELECT 'lon', min(lon), max(lon), count(DISTINCT lon) FROM fx_cells""",
    ),
    "scan_point_series": (
        lambda s, d: as_text(Q.scan_point_series(fixture(s, d, "events").select("event_id", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("reading"), F.col("ts").alias("time")), "reading"), "time"),
        "SELECT CAST(ts AS VARCHAR) AS time, round(value, 6) AS value FROM events WHERE event_id % 9 > 0",
    ),
    "point_timeseries": (
        lambda s, d: as_text(Q.point_timeseries(fixture(s, d, "events").select(F.col("ts").alias("time"), "value"), "value", "2024-01-05", "2024-01-20"), "time"),
        "SELECT CAST(ts AS VARCHAR) AS time, round(value, 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'",
    ),
    "scan_ground_records": (_scan_ground, ctes("fx_samples") + "SELECT * EXCLUDE (record_no) FROM fx_samples"),
    "concat_granules": (
        _concat,
        ctes("fx_granule_cells") + "SELECT granule_id, count(*) AS n, count(*) FILTER (collection <> 'F') AS n_band, round(max(value), 6) AS top FROM fx_granule_cells GROUP BY granule_id",
    ),
    "synthesize_time": (
        lambda s, d: as_text(S.synthesize_time(_attrs(s, d)).select("o_orderkey", "ts"), "ts"),
        f"""WITH a AS ({_ATTRS}) SELECT o_orderkey, CAST(coalesce(ts, try_cast(concat(bd, 'T', coalesce(rtrim(bt, 'Z'), '00:00:00')) AS TIMESTAMP)) AS VARCHAR) AS ts FROM a""",
    ),
    "attrs_time_range": (
        lambda s, d: S.attrs_time_range(_attrs(s, d)).select("o_orderkey", "coverage_start", "coverage_end"),
        f"""WITH a AS ({_ATTRS}) SELECT o_orderkey, coalesce(cs, CASE WHEN bt <> '' AND NOT contains(bd, 'T') THEN concat(bd, 'T', rtrim(bt, 'Z')) ELSE bd END, '') AS coverage_start,
        coalesce(CASE WHEN ed IS NOT NULL THEN concat(ed, 'T23:59:59') END, '') AS coverage_end FROM a""",
    ),
    "dedup_time": (
        lambda s, d: as_text(S.dedup_time(fixture(s, d, "fx_granule_cells")).select("collection", "granule_id", "ts", "i", "j", "value"), "ts"),
        ctes("fx_granule_cells") + """SELECT collection, granule_id, CAST(ts AS VARCHAR) AS ts, i, j, value FROM fx_granule_cells g
        WHERE granule_id = (SELECT min(granule_id) FROM fx_granule_cells h WHERE h.collection = g.collection AND h.ts = g.ts)""",
    ),
    "duplicate_report": (
        lambda s, d: S.duplicate_report(fixture(s, d, "fx_granule_cells")),
        ctes("fx_granule_cells") + "SELECT collection, count(DISTINCT ts) AS kept, CAST(count(DISTINCT [CAST(ts AS VARCHAR), granule_id]) - count(DISTINCT ts) AS BIGINT) AS duplicates FROM fx_granule_cells GROUP BY collection",
    ),
    "load_regions": (
        _places,
        f"""SELECT p.region_id, p.name, CASE WHEN p.name IS NOT NULL THEN 'bounding_box' END AS region_type, minx, miny, maxx, maxy, count(*) AS n
        FROM (SELECT lower(r_name) AS region_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) c
        LEFT JOIN {_PLACES} ON p.region_id = c.region_id GROUP BY ALL""".replace("SELECT p.region_id, p.name", "SELECT c.region_id, p.name"),
    ),
    "unique_headers": (
        lambda s, d: X.unique_headers(D.valid_timesteps(masked_hourly(s, d)).withColumn("day", F.to_date("ts").cast("string")), "day", "ts").select(F.col("ts").cast("string"), "header"),
        ctes("fx_hourly", masked=MASKED_HOURLY, v="SELECT DISTINCT ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM masked WHERE value IS NOT NULL", k="SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS k FROM v")
        + "SELECT CAST(ts AS VARCHAR) AS ts, CASE WHEN k = 1 THEN day ELSE concat(day, '_', k) END AS header FROM k",
    ),
    "export_cells_csv": (
        _export_cells,
        ctes("fx_cells", masked=MASKED, regioned=REGIONED, field=TEMPORAL_MEAN) + "SELECT region_id AS panel, 'price' AS variable, lat AS latitude, lon AS longitude, round(value, 6) AS value, 'usd' AS units FROM field",
    ),
    "export_wide_csv": (
        _export_wide,
        ctes("fx_hourly", masked=MASKED_HOURLY, v="SELECT DISTINCT ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM masked WHERE value IS NOT NULL",
             h="SELECT ts, CASE WHEN k = 1 THEN day ELSE concat(day, '_', k) END AS header FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS k FROM v)")
        + """SELECT 'reading' AS variable, lat AS latitude, lon AS longitude, 'ppb' AS units, header, round(value, 6) AS value FROM masked JOIN h USING (ts) WHERE value IS NOT NULL
        UNION ALL SELECT 'reading', lat, lon, 'ppb', 'mean', round(avg(value), 6) FROM masked WHERE value IS NOT NULL GROUP BY lat, lon""",
    ),
    "export_series_csv": (
        _export_series,
        ctes("fx_cells", masked=MASKED) + f"SELECT 'price' AS variable, CAST(ts AS VARCHAR) AS time, 'mean' AS stat, round(sum(value * {W}) / sum({W}), 6) AS value, 'usd' AS units FROM masked WHERE {IN_A} AND value IS NOT NULL GROUP BY ts",
    ),
}

"""Registered queries: axes, levels and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import BOXES, IN_A, SUBCELL, TRIANGLE, as_text
from cellwright.catalog.fixtures import ctes, fixture
from cellwright.operators import regions as R
from cellwright.session import settle

_ID = ["i", "j", "ts", "raw_value"]


def _shifted(s, d):
    """The grid on 0..360 longitudes, numbered from the east so that the order changes."""
    cells = fixture(s, d, "fx_cells")
    return cells.withColumns({"lon": F.col("lon") + 360, "j": 99 - F.col("j")})


def _mixed_grids(s, d):
    """Six grids by month: regular, uneven, two-dimensional, and three without latitude, one in metres, one with a named projection."""
    kind = F.month("ts") % 6
    return fixture(s, d, "fx_cells").select(
        F.concat(F.lit("G"), kind.cast("string")).alias("grid"), "i", "j",
        F.when(kind == 1, F.col("lat") + F.col("i") * F.col("i") / 100).when(kind >= 3, None).otherwise(F.col("lat")).alias("lat"),
        F.when(kind == 2, F.col("lon") + F.col("i") / 10).otherwise(F.col("lon")).alias("lon"),
    )


def _kinds(s, d):
    told = s.createDataFrame([("G3", None, "degrees", "m"), ("G4", None, " Metres", "m"), ("G5", "lambert_conformal_conic", None, None), ("G0", "wgs84", "m", "m")], "grid string, crs string, x_units string, y_units string")
    return R.grid_kind(_mixed_grids(s, d), ["grid"], told)


def _guarded(s, d):
    kinds = settle(_kinds(s, d), "kinds")
    refused = R.grid_refusals(kinds).select("grid", "grid_kind", "reason", F.lit(None).cast("double").alias("cells"))
    kept = R.supported_cells(_mixed_grids(s, d), kinds, ["grid"]).groupBy("grid").agg(F.count("*").cast("double").alias("cells"))
    return refused.unionByName(kept.select("grid", F.lit(None).cast("string").alias("grid_kind"), F.lit(None).cast("string").alias("reason"), "cells"))


def _edges(s, polygons=TRIANGLE):
    return R.polygon_edges(s, polygons)


_SMALL = {"tiny": [[(-118.4, 21.1), (-118.1, 21.1), (-118.1, 21.4), (-118.4, 21.4)]], **TRIANGLE}
_TRI = """edges AS (SELECT * FROM (VALUES ('T', -119.0::DOUBLE, 21.0::DOUBLE, -76.0::DOUBLE, 21.0::DOUBLE), ('T', -76.0, 21.0, -98.0, 57.0), ('T', -98.0, 57.0, -119.0, 21.0)) e(region_id, x1, y1, x2, y2)),
grid AS (SELECT DISTINCT lat, lon FROM fx_cells),
tri AS (SELECT g.lat, g.lon FROM grid g JOIN edges e ON g.lat BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY g.lat, g.lon
  HAVING sum(CASE WHEN (y1 <= lat) <> (y2 <= lat) AND x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)) > lon THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or(CASE WHEN y1 = y2 THEN lon BETWEEN least(x1, x2) AND greatest(x1, x2) ELSE lon = x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)) END))
"""


def _with(sql: str, text: str) -> str:
    return sql.rstrip() + ",\n" + text


def _boxes(s, d):
    m = fixture(s, d, "fx_monitors").select("site_number", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), "site_key")
    wide = F.col("site_key") % 4 * F.lit(0.2)
    return m.select("site_number", (F.col("lat") - wide).alias("south"), (F.col("lat") + wide).alias("north"),
                    (F.col("lon") - 0.05).alias("west"), (F.col("lon") + 0.05).alias("east"))


_BOXES = """SELECT site_number, CAST(latitude AS DOUBLE) - site_key % 4 * CAST(0.2 AS DOUBLE) AS south, CAST(latitude AS DOUBLE) + site_key % 4 * CAST(0.2 AS DOUBLE) AS north,
  CAST(longitude AS DOUBLE) - CAST(0.05 AS DOUBLE) AS west, CAST(longitude AS DOUBLE) + CAST(0.05 AS DOUBLE) AS east FROM fx_monitors"""
_MIN = """SELECT site_number, (south + north) / 2 - greatest((north - south) / 2, CAST(0.25 AS DOUBLE)) AS south, (south + north) / 2 + greatest((north - south) / 2, CAST(0.25 AS DOUBLE)) AS north,
  (west + east) / 2 - greatest((east - west) / 2, CAST(0.25 AS DOUBLE)) AS west, (west + east) / 2 + greatest((east - west) / 2, CAST(0.25 AS DOUBLE)) AS east FROM boxes"""


def _round_box(df):
    return df.withColumns({n: F.round(n, 6) for n in ("south", "north", "west", "east")})


_ROUND = "round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east"

_KINDS = dict(
    g="""SELECT concat('G', CAST(month(ts) % 6 AS VARCHAR)) AS grid, i, j,
      CASE month(ts) % 6 WHEN 1 THEN lat + i * i / CAST(100 AS DOUBLE) WHEN 0 THEN lat WHEN 2 THEN lat END AS lat,
      CASE month(ts) % 6 WHEN 2 THEN lon + i / CAST(10 AS DOUBLE) ELSE lon END AS lon FROM fx_cells""",
    two="""SELECT grid, bool_or(n > 1) AS curved, bool_or(miss) AS none_ FROM (SELECT grid, count(DISTINCT lat) AS n, count(lat) < count(*) AS miss FROM g GROUP BY grid, i
      UNION ALL SELECT grid, count(DISTINCT lon), count(lon) < count(*) FROM g GROUP BY grid, j) GROUP BY grid""",
    ax="SELECT DISTINCT grid, 'y' AS axis, i AS p, lat AS v FROM g UNION SELECT DISTINCT grid, 'x', j, lon FROM g",
    st="SELECT a.grid, a.axis, b.v - a.v AS step FROM ax a JOIN ax b ON a.grid = b.grid AND a.axis = b.axis AND b.p = a.p + 1",
    md="SELECT *, median(step) OVER (PARTITION BY grid, axis) AS m FROM st WHERE step IS NOT NULL",
    reg="SELECT grid, bool_and(abs(step - m) <= CAST(0.001 AS DOUBLE) * abs(m)) AS regular FROM md GROUP BY grid",
    kinds="""SELECT two.grid, CASE WHEN none_ AND two.grid IN ('G4', 'G5') THEN 'projected' WHEN none_ THEN 'none' WHEN curved THEN 'curvilinear' WHEN regular THEN 'rectilinear' ELSE 'irregular' END AS grid_kind
      FROM two LEFT JOIN reg USING (grid)""",
)

QUERIES = {
    "normalize_longitude": (
        lambda s, d: as_text(R.normalize_longitude(_shifted(s, d), ["collection"]).select("i", "j", "ts", F.round("lon", 6).alias("lon"), "raw_value"), "ts"),
        ctes("fx_cells") + """SELECT i, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INT) AS j, CAST(ts AS VARCHAR) AS ts, round(lon, 6) AS lon, raw_value FROM fx_cells""",
    ),
    "grid_axes": (
        lambda s, d: R.pixel_edges(R.grid_axes(fixture(s, d, "fx_cells"), ["collection"])),
        ctes("fx_cells", a="SELECT collection, min(lat) AS lat_min, max(lat) AS lat_max, count(DISTINCT lat) AS n_lat, min(lon) AS lon_min, max(lon) AS lon_max, count(DISTINCT lon) AS n_lon FROM fx_cells GROUP BY collection")
        + """SELECT *, lon_min - (lon_max - lon_min) / (n_lon - 1) / 2 AS edge_west, lon_max + (lon_max - lon_min) / (n_lon - 1) / 2 AS edge_east,
        lat_min - (lat_max - lat_min) / (n_lat - 1) / 2 AS edge_south, lat_max + (lat_max - lat_min) / (n_lat - 1) / 2 AS edge_north FROM a""",
    ),
    "grid_kind": (_kinds, ctes("fx_cells", **_KINDS) + "SELECT grid, grid_kind FROM kinds"),
    "grid_refusals": (
        _guarded,
        ctes("fx_cells", **_KINDS) + """SELECT grid, grid_kind, CASE grid_kind WHEN 'irregular' THEN 'steps of an axis differ, so cells have no common size' WHEN 'curvilinear' THEN 'rows and columns have no latitude and longitude of their own'
          ELSE 'positions are in metres of a projection, not degrees' END AS reason, CAST(NULL AS DOUBLE) AS cells FROM kinds WHERE grid_kind IN ('irregular', 'curvilinear', 'projected')
        UNION ALL SELECT grid, NULL, NULL, CAST(count(*) AS DOUBLE) FROM g JOIN kinds USING (grid) WHERE grid_kind IN ('rectilinear', 'none') GROUP BY grid""",
    ),
    "crop_bounds": (
        lambda s, d: as_text(R.crop_bounds(fixture(s, d, "fx_cells"), BOXES["A"]).select(*_ID), "ts"),
        ctes("fx_cells") + f"SELECT i, j, CAST(ts AS VARCHAR) AS ts, raw_value FROM fx_cells WHERE {IN_A}",
    ),
    "region_mask_box": (
        lambda s, d: as_text(R.region_mask_box(fixture(s, d, "fx_cells"), BOXES["B"], "B").select(*_ID, "region_id", "region_type"), "ts"),
        ctes("fx_cells") + """SELECT i, j, CAST(ts AS VARCHAR) AS ts, raw_value, 'B' AS region_id, 'bounding_box' AS region_type
        FROM fx_cells WHERE lon BETWEEN -100 AND -75 AND lat BETWEEN 30 AND 58""",
    ),
    "region_mask_polygon": (
        lambda s, d: as_text(R.region_mask_polygon(fixture(s, d, "fx_cells"), _edges(s)).select(*_ID, "region_id"), "ts"),
        _with(ctes("fx_cells"), _TRI) + "SELECT i, j, CAST(ts AS VARCHAR) AS ts, raw_value, 'T' AS region_id FROM fx_cells JOIN tri USING (lat, lon)",
    ),
    "region_mask_boundary": (
        lambda s, d: as_text(R.region_mask_box(fixture(s, d, "fx_cells"), SUBCELL, "S").select(*_ID, "region_type"), "ts"),
        ctes("fx_cells") + """SELECT i, j, CAST(ts AS VARCHAR) AS ts, raw_value, 'boundary_cells' AS region_type FROM fx_cells
        WHERE lon + 0.25 >= -118.4 AND lon - 0.25 <= -118.1 AND lat + 0.25 >= 21.1 AND lat - 0.25 <= 21.4""",
    ),
    "region_mask_boundary_polygon": (
        lambda s, d: as_text(R.region_mask_boundary(fixture(s, d, "fx_cells"), _edges(s, _SMALL)).select(*_ID, "region_id", "region_type"), "ts"),
        _with(ctes("fx_cells"), _TRI) + """SELECT i, j, CAST(ts AS VARCHAR) AS ts, raw_value, 'T' AS region_id, 'polygon' AS region_type FROM fx_cells JOIN tri USING (lat, lon)
        UNION ALL SELECT i, j, CAST(ts AS VARCHAR), raw_value, 'tiny', 'boundary_cells' FROM fx_cells
        WHERE lon + 0.25 >= -118.4 AND lon - 0.25 <= -118.1 AND lat + 0.25 >= 21.1 AND lat - 0.25 <= 21.4""",
    ),
    "select_level": (
        lambda s, d: as_text(R.select_level(fixture(s, d, "fx_level_cells"), 75.0), "ts"),
        ctes("fx_level_cells") + "SELECT i, j, level, CAST(ts AS VARCHAR) AS ts, value FROM fx_level_cells WHERE level = (SELECT level FROM fx_level_cells ORDER BY abs(level - 75), level DESC LIMIT 1)",
    ),
    "level_choice": (
        lambda s, d: R.level_choice(fixture(s, d, "fx_level_cells"), 62.0).unionByName(R.level_choice(fixture(s, d, "fx_level_cells"), 500.0)),
        ctes("fx_level_cells") + """SELECT CAST(r AS DOUBLE) AS requested, min(level) AS level_min, max(level) AS level_max,
        CASE WHEN r BETWEEN min(level) AND max(level) THEN arg_min(level, abs(level - r)) END AS level,
        CASE WHEN r BETWEEN min(level) AND max(level) THEN 'selected' ELSE 'dimension_choice_required' END AS status
        FROM fx_level_cells, (VALUES (62), (500)) v(r) GROUP BY r""",
    ),
    "select_level_position": (
        lambda s, d: as_text(R.select_level_position(fixture(s, d, "fx_level_cells"), 1), "ts"),
        ctes("fx_level_cells") + "SELECT i, j, level, CAST(ts AS VARCHAR) AS ts, value FROM fx_level_cells WHERE level = (SELECT DISTINCT level FROM fx_level_cells ORDER BY level LIMIT 1 OFFSET 1)",
    ),
    "require_choice": (
        lambda s, d: as_text(R.require_choice(fixture(s, d, "fx_level_cells"), ["ts"]), "ts"),
        ctes("fx_level_cells") + """SELECT CAST(ts AS VARCHAR) AS ts, count(DISTINCT level) AS n_levels,
        array_to_string(list_sort(list(DISTINCT level)), ', ') AS choices, count(DISTINCT level) > 1 AS refused FROM fx_level_cells GROUP BY ts""",
    ),
    "min_bbox": (
        lambda s, d: _round_box(R.min_bbox(_boxes(s, d))),
        ctes("fx_monitors", boxes=_BOXES, m=_MIN) + f"SELECT site_number, {_ROUND} FROM m",
    ),
    "expand_bbox": (
        lambda s, d: _round_box(R.expand_bbox(R.min_bbox(_boxes(s, d)))),
        ctes("fx_monitors", boxes=_BOXES, m=_MIN) + f"""SELECT site_number, step, degrees, {_ROUND} FROM
        (SELECT site_number, step, degrees, south - degrees AS south, north + degrees AS north, west - degrees AS west, east + degrees AS east
         FROM m, (VALUES (0, 0.0::DOUBLE), (1, 0.5), (2, 1.5), (3, 3.0), (4, 5.0)) v(step, degrees))""",
    ),
}

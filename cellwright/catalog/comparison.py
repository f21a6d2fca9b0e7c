"""Registered queries: comparisons, scales, maps and thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import BOXES, FILL, GOOD, TRIANGLE, VMAX, VMIN, IN_A, MASKED, REGIONED, TEMPORAL_MEAN, W, as_text, masked_cells, r6
from cellwright.catalog.fixtures import ctes, fixture
from cellwright.operators import comparison as C
from cellwright.operators import display as P
from cellwright.operators import masking as M
from cellwright.operators import reductions as D
from cellwright.operators import regions as R
from cellwright.plans import maps
from cellwright.session import settle

KEY = ["region_id"]


def _sides(s, d):
    """Box A before 1998-07 as side A, after it as side B."""
    cells = R.crop_bounds(masked_cells(s, d), BOXES["A"])
    return cells.withColumn("side", F.when(F.col("ts") < "1998-07-01", "A").otherwise("B"))


def _regions_as_sides(s, d):
    return R.with_regions(masked_cells(s, d), BOXES).withColumnRenamed("region_id", "side")


def _diff(s, d):
    return settle(maps.period_comparison(_sides(s, d), "monthly"), "difference")


# The two sides take the place of the regions in the shared texts.
_PERIODS = f"SELECT *, CASE WHEN ts < DATE '1998-07-01' THEN 'A' ELSE 'B' END AS region_id FROM masked WHERE {IN_A}"
_DIFF = """SELECT a.i, a.j, a.lat, a.lon, a.value AS a, b.value AS b, b.value - a.value AS diff
  FROM (SELECT * FROM field WHERE region_id = 'A') a JOIN (SELECT * FROM field WHERE region_id = 'B') b ON a.i = b.i AND a.j = b.j"""


def _psql(body: str, **extra: str) -> str:
    return ctes("fx_cells", masked=MASKED, regioned=_PERIODS, field=TEMPORAL_MEAN, diff=_DIFF, **extra) + body


def _rsql(body: str, **extra: str) -> str:
    return ctes("fx_cells", masked=MASKED, regioned=REGIONED, field=TEMPORAL_MEAN, **extra) + body


def _field(s, d):
    return settle(D.temporal_mean(R.with_regions(masked_cells(s, d), BOXES), "monthly", KEY), "field")


def _shared(s, d):
    field = _field(s, d)
    return C.shared_bounds(field.where("region_id = 'A'"), field.where("region_id = 'B'"))


def _sourced(s, d):
    """Three comparisons' worth of sources are one collection each; here two labels by line status."""
    g = fixture(s, d, "fx_granule_cells")
    return g.select("i", "j", "ts", "value", F.concat(F.lit("cube_"), "collection").alias("source"),
                    F.when(F.col("collection") == "F", 1).otherwise(0).alias("source_no"))


def _coarse(s, d):
    """The box B field on its own half-degree grid, and box A's on a coarser, shifted grid."""
    g = fixture(s, d, "fx_cells")
    b = g.groupBy((F.col("i") / 3).cast("int").alias("i"), (F.col("j") / 3).cast("int").alias("j")).agg(F.max("cloud_fraction").alias("value"))
    b = b.withColumns({"lat": 20.3 + 1.5 * F.col("i"), "lon": -119.8 + 1.5 * F.col("j")})
    a = g.groupBy("i", "j", "lat", "lon").agg(F.max("value_uncertainty").alias("value"))
    return a, b


def _guard_rows(s, d):
    """One comparison per day: sides by line status of the granule, variable and units by the day."""
    c = fixture(s, d, "fx_granule_cells")
    n = F.dayofyear("ts")
    b = F.col("collection") == "F"
    return c.select(
        F.col("ts").alias("day"), F.when(b, "B").otherwise("A").alias("side"), F.col("ts"),
        F.when(b & (n % 5 == 0), "o3").otherwise("no2").alias("variable"),
        F.when(n % 3 == 0, "").when(b & (n % 7 == 0), "").when(b & (n % 11 == 0), "DU").otherwise("mol").alias("units"),
        F.when((n % 13 != 0) | b, F.col("value")).alias("value"),
    )


def _ranges(s, d):
    c = fixture(s, d, "fx_granule_cells")
    b = F.col("collection") == "F"
    return c.select("i", F.when(b, "B").otherwise("A").alias("side"), F.lit("v").alias("variable"), F.lit("u").alias("units"), "value",
                    F.when(b & (F.col("i") % 2 == 0), F.add_months("ts", 120)).otherwise(F.col("ts")).alias("ts"))


_ALLCELLS = """SELECT c.region_id, c.i, c.j, c.lat, c.lon, f.value FROM (SELECT DISTINCT region_id, i, j, lat, lon FROM regioned) c LEFT JOIN field f USING (region_id, i, j)"""

_HEAT = f"""SELECT t.region_id, t.i, t.j, t.lat, t.lon, CAST(printf('%.6e', t.value) AS DOUBLE) AS value, CAST(printf('%.6e', p.vmin) AS DOUBLE) AS vmin,
  CAST(printf('%.6e', p.vmax) AS DOUBLE) AS vmax, s.count, s.valid_fraction, s.mean, s.min, s.max FROM
  allcells t
  JOIN (SELECT region_id, quantile_cont(value, 0.02) AS vmin, quantile_cont(value, 0.98) AS vmax FROM field GROUP BY region_id) p USING (region_id)
  JOIN (SELECT region_id, count(value) AS count, round(count(value) / count(*), 6) AS valid_fraction, CAST(printf('%.6e', sum(value * {W}) / sum({W}) FILTER (value IS NOT NULL)) AS DOUBLE) AS mean,
        CAST(printf('%.6e', min(value)) AS DOUBLE) AS min, CAST(printf('%.6e', max(value)) AS DOUBLE) AS max FROM allcells GROUP BY region_id) s USING (region_id)"""


def _shape(limit: int) -> str:
    return f"""SELECT region_id, min(i) AS i0, min(j) AS j0, CASE WHEN (max(i) - min(i) + 1) * (max(j) - min(j) + 1) <= {limit} THEN 1
    ELSE CAST(ceil(sqrt((max(i) - min(i) + 1) * (max(j) - min(j) + 1) / {limit})) AS INT) END AS step FROM allcells GROUP BY region_id"""


def _whole_field(s, d):
    return fixture(s, d, "fx_cells").groupBy("i", "j", "lat", "lon").agg(F.max("raw_value").alias("value"))


_WHOLE = "SELECT i, j, lat, lon, max(raw_value) AS value FROM fx_cells GROUP BY i, j, lat, lon"
_ONE_REGION = "SELECT 'w' AS region_id, * FROM whole"

QUERIES = {
    "split_sources": (
        lambda s, d: as_text(C.split_sources(_sourced(s, d), "cube_O", "cube_F"), "ts")
        .unionByName(as_text(C.split_sources(_sourced(s, d), "cube_F", "cube_X"), "ts")).groupBy("side", "source").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")),
        ctes("fx_granule_cells", g="SELECT *, concat('cube_', collection) AS source FROM fx_granule_cells")
        + """SELECT side, source, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT CASE source WHEN 'cube_O' THEN 'A' ELSE 'B' END AS side, source, value FROM g
        UNION ALL SELECT CASE source WHEN 'cube_O' THEN 'A' ELSE 'B' END, source, value FROM g) GROUP BY side, source""",
    ),
    "align_grids": (
        lambda s, d: r6(C.align_grids(*_coarse(s, d)), "a", "b"),
        ctes("fx_cells", b="""SELECT i, j, CAST(20.3 AS DOUBLE) + CAST(1.5 AS DOUBLE) * i AS lat, CAST(-119.8 AS DOUBLE) + CAST(1.5 AS DOUBLE) * j AS lon, value FROM
             (SELECT CAST(floor(i / 3) AS INT) AS i, CAST(floor(j / 3) AS INT) AS j, max(cloud_fraction) AS value FROM fx_cells GROUP BY 1, 2)""",
             a="SELECT i, j, lat, lon, max(value_uncertainty) AS value FROM fx_cells GROUP BY i, j, lat, lon",
             la="SELECT lat, blat FROM (SELECT x.lat, y.lat AS blat, row_number() OVER (PARTITION BY x.lat ORDER BY abs(x.lat - y.lat), y.lat DESC) AS rn FROM (SELECT DISTINCT lat FROM a) x, (SELECT DISTINCT lat FROM b) y) WHERE rn = 1 AND abs(lat - blat) <= 1.5",
             lo="SELECT lon, blon FROM (SELECT x.lon, y.lon AS blon, row_number() OVER (PARTITION BY x.lon ORDER BY abs(x.lon - y.lon), y.lon DESC) AS rn FROM (SELECT DISTINCT lon FROM a) x, (SELECT DISTINCT lon FROM b) y) WHERE rn = 1 AND abs(lon - blon) <= 1.5")
        + """SELECT a.i, a.j, a.lat, a.lon, round(a.value, 6) AS a, round(b.value, 6) AS b FROM a JOIN la USING (lat) JOIN lo USING (lon) JOIN b ON b.lat = blat AND b.lon = blon""",
    ),
    "period_difference": (
        lambda s, d: r6(_diff(s, d), "a", "b", "diff"),
        _psql("SELECT i, j, lat, lon, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM diff"),
    ),
    "region_stats": (
        lambda s, d: r6(C.region_stats(_field(s, d), KEY), "mean", "median", "max", "min"),
        _rsql(f"""SELECT region_id, round(sum(value * {W}) / sum({W}), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min,
        count(value) AS n_pixels, 'period-mean' AS basis FROM field GROUP BY region_id"""),
    ),
    "region_comparison": (
        lambda s, d: r6(maps.region_comparison(_regions_as_sides(s, d), "monthly"), "mean", "median", "max", "min", "vmin", "vmax"),
        _rsql(f"""SELECT region_id AS side, round(sum(value * {W}) / sum({W}), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min,
        count(value) AS n_pixels, 'period-mean' AS basis, (SELECT round(quantile_cont(value, 0.02), 6) FROM field) AS vmin, (SELECT round(quantile_cont(value, 0.98), 6) FROM field) AS vmax FROM field GROUP BY region_id"""),
    ),
    "anomaly_stats": (
        lambda s, d: r6(C.anomaly_stats(_diff(s, d), 20.0), "mean_difference", "percent_change", "fraction_exceeding"),
        _psql(f"""SELECT count(*) AS n_cells, round(sum(diff * {W}) / sum({W}), 6) AS mean_difference,
        round(CASE WHEN abs(sum(a * {W}) / sum({W})) >= 0.05 * (quantile_cont(abs(a), 0.98) - quantile_cont(abs(a), 0.02)) THEN (sum(diff * {W}) / sum({W})) / (sum(a * {W}) / sum({W})) * 100 END, 6) AS percent_change,
        abs(sum(a * {W}) / sum({W})) < 0.05 * (quantile_cont(abs(a), 0.98) - quantile_cont(abs(a), 0.02)) AS percent_change_withheld,
        count(*) FILTER (abs(diff) >= 20) AS n_exceeding, round(count(*) FILTER (abs(diff) >= 20) / count(*), 6) AS fraction_exceeding FROM diff"""),
    ),
    "percentile_bounds": (
        lambda s, d: r6(C.percentile_bounds(_field(s, d), KEY), "vmin", "vmax"),
        _rsql("SELECT region_id, round(quantile_cont(value, 0.02), 6) AS vmin, round(quantile_cont(value, 0.98), 6) AS vmax FROM field GROUP BY region_id"),
    ),
    "shared_bounds": (
        lambda s, d: r6(_shared(s, d), "vmin", "vmax"),
        _rsql("SELECT round(quantile_cont(value, 0.02), 6) AS vmin, round(quantile_cont(value, 0.98), 6) AS vmax FROM field"),
    ),
    "diverging_bounds": (
        lambda s, d: r6(C.diverging_bounds(_diff(s, d)), "vmin", "vmax"),
        _psql("SELECT round(-quantile_cont(abs(diff), 0.98), 6) AS vmin, round(quantile_cont(abs(diff), 0.98), 6) AS vmax FROM diff"),
    ),
    "disjoint_periods": (
        lambda s, d: as_text(C.disjoint_periods(_ranges(s, d), ["i"]), "start_A", "end_A", "start_B", "end_B"),
        ctes("fx_granule_cells", r="SELECT i, collection, CASE WHEN collection = 'F' AND i % 2 = 0 THEN CAST(ts + INTERVAL 120 MONTH AS DATE) ELSE ts END AS ts FROM fx_granule_cells",
             f="""SELECT i, min(ts) FILTER (collection <> 'F') AS sa, max(ts) FILTER (collection <> 'F') AS ea, min(ts) FILTER (collection = 'F') AS sb, max(ts) FILTER (collection = 'F') AS eb FROM r GROUP BY i""")
        + """SELECT i, CAST(sa AS VARCHAR) AS "start_A", CAST(ea AS VARCHAR) AS "end_A", CAST(sb AS VARCHAR) AS "start_B", CAST(eb AS VARCHAR) AS "end_B", ea < sb OR eb < sa AS disjoint FROM f""",
    ),
    "compare_guards": (
        lambda s, d: as_text(C.compare_guards(_guard_rows(s, d), ["day"]), "day"),
        ctes("fx_granule_cells", r="SELECT ts AS day, collection = 'F' AS b, dayofyear(ts) AS n, value FROM fx_granule_cells",
             f="""SELECT day, max(n) AS n, bool_or(b) AS hb, bool_or(NOT b) AS ha FROM r GROUP BY day""")
        + """SELECT CAST(day AS VARCHAR) AS day, CASE WHEN ha AND hb AND n % 5 = 0 THEN 'variable mismatch'
          WHEN ha AND hb AND n % 3 <> 0 AND n % 7 <> 0 AND n % 11 = 0 THEN 'units mismatch'
          WHEN n % 3 <> 0 AND (NOT ha AND hb AND n % 7 <> 0 OR ha AND (NOT hb OR n % 7 = 0)) THEN 'units missing on one side'
          WHEN NOT ha OR n % 13 = 0 THEN 'no valid data for A' WHEN NOT hb THEN 'no valid data for B' END AS refusal FROM f""",
    ),
    "thin_grid": (
        lambda s, d: P.thin_grid(_whole_field(s, d), max_cells=8000),
        ctes("fx_cells", whole=_WHOLE, allcells=_ONE_REGION, shape=_shape(8000)) + """SELECT a.i, a.j, a.lat, a.lon, a.value FROM allcells a JOIN shape h USING (region_id)
        WHERE (a.i - h.i0) % h.step = 0 AND (a.j - h.j0) % h.step = 0""",
    ),
    "sample_points": (
        lambda s, d: P.sample_points(_whole_field(s, d), max_points=8000),
        ctes("fx_cells", whole=_WHOLE, r="SELECT *, row_number() OVER (ORDER BY i, j) - 1 AS pos, count(*) OVER () AS n FROM whole WHERE value IS NOT NULL",
             take="SELECT DISTINCT CASE WHEN k = 7999 THEN n - 1 ELSE CAST(floor(k * ((n - 1) / CAST(7999 AS DOUBLE))) AS BIGINT) END AS pos FROM (SELECT max(n) AS n FROM r), range(0, 8000) t(k)")
        + """SELECT i, j, lat, lon, CAST(printf('%.6e', value) AS DOUBLE) AS value FROM r WHERE n <= 8000 OR pos IN (SELECT pos FROM take)""",
    ),
    "heatmap": (
        lambda s, d: maps.heatmap(R.with_regions(masked_cells(s, d), {"A": BOXES["A"]}), "monthly", KEY),
        ctes("fx_cells", masked=MASKED, regioned=f"SELECT *, 'A' AS region_id FROM masked WHERE {IN_A}", field=TEMPORAL_MEAN, allcells=_ALLCELLS) + _HEAT,
    ),
    "heatmap_multi": (
        lambda s, d: maps.heatmap(R.with_regions(masked_cells(s, d), BOXES), "monthly", KEY),
        _rsql(_HEAT, allcells=_ALLCELLS),
    ),
    "heatmap_polygon": (
        lambda s, d: maps.heatmap(M.mask_cells(R.polygon_panels(fixture(s, d, "fx_cells"), TRIANGLE), fill=FILL, vmin=VMIN, vmax=VMAX, good=GOOD), "monthly", KEY),
        ctes("fx_cells", masked=MASKED,
             edges="SELECT * FROM (VALUES (-119.0::DOUBLE, 21.0::DOUBLE, -76.0::DOUBLE, 21.0::DOUBLE), (-76.0, 21.0, -98.0, 57.0), (-98.0, 57.0, -119.0, 21.0)) e(x1, y1, x2, y2)",
             tri="""SELECT g.lat, g.lon FROM (SELECT DISTINCT lat, lon FROM fx_cells) g JOIN edges e ON g.lat BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY g.lat, g.lon
               HAVING sum(CASE WHEN (y1 <= lat) <> (y2 <= lat) AND x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)) > lon THEN 1 ELSE 0 END) % 2 = 1
               OR bool_or(CASE WHEN y1 = y2 THEN lon BETWEEN least(x1, x2) AND greatest(x1, x2) ELSE lon = x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)) END)""",
             regioned="""SELECT m.* EXCLUDE (value), CASE WHEN t.lat IS NOT NULL THEN m.value END AS value, 'T' AS region_id FROM masked m LEFT JOIN tri t ON t.lat = m.lat AND t.lon = m.lon
               WHERE m.lon BETWEEN -119 AND -76 AND m.lat BETWEEN 21 AND 57""",
             field=TEMPORAL_MEAN, allcells=_ALLCELLS) + _HEAT,
    ),
    "color_index": (
        lambda s, d: P.colorize(_field(s, d), C.percentile_bounds(_field(s, d), KEY), KEY).select("region_id", "i", "j", F.col("color").cast("double")),
        _rsql("""SELECT region_id, i, j, CASE WHEN value IS NOT NULL THEN CAST(round_even(least(greatest((value - vmin) / (vmax - vmin), 0), 1) * 255, 0) AS DOUBLE) END AS color FROM allcells
        JOIN (SELECT region_id, quantile_cont(value, 0.02) AS vmin, quantile_cont(value, 0.98) AS vmax FROM field GROUP BY region_id) USING (region_id)""", allcells=_ALLCELLS),
    ),
}

"""Registered queries: reductions over time and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import (
    BOXES, GOOD, MASKED, MASKED_HOURLY, REGIONED, TEMPORAL_MEAN, W, as_text, masked_cells, masked_hourly, r6,
)
from cellwright.catalog.fixtures import ctes
from cellwright.operators import provenance as P
from cellwright.operators import reductions as D
from cellwright.operators import regions as R
from cellwright.plans import maps

KEY = ["region_id"]


def _regioned(s, d):
    return R.with_regions(masked_cells(s, d), BOXES)


def _sql(body: str, **extra: str) -> str:
    return ctes("fx_cells", masked=MASKED, regioned=REGIONED, **extra) + body


def _field(s, d):
    return D.temporal_mean(_regioned(s, d), "monthly", KEY)


_CELL_STATS = """SELECT region_id, i, j, lat, lon, avg(value) AS a, median(value) AS med, max(value) AS mx, min(value) AS mn, stddev_samp(value) AS sd FROM regioned GROUP BY region_id, i, j, lat, lon"""
_ALLCELLS = """SELECT c.region_id, c.i, c.j, c.lat, c.lon, f.value FROM (SELECT DISTINCT region_id, i, j, lat, lon FROM regioned) c LEFT JOIN field f USING (region_id, i, j)"""


def _temporal_stats(s, d):
    stats = ["median", "max", "min", "std"]
    return r6(D.temporal_fields(_regioned(s, d), "unknown", KEY, stats).unpivot(["region_id", "i", "j"], stats, "stat", "value"), "value")


def _series_all(s, d):
    cells = masked_hourly(s, d)
    out = None
    for stat in ("mean", "median", "max", "min", "std"):
        one = D.regional_timeseries(cells, stat).select("ts", F.lit(stat).alias("stat"), "value")
        out = one if out is None else out.unionByName(one)
    return as_text(out, "ts")


def _label(s, d):
    cells = masked_hourly(s, d).withColumns({"day": F.dayofmonth("ts").cast("int"), "ts": F.col("ts")})
    hourly = D.aggregation_label(D.valid_timesteps(cells, ["day"]), "hourly", "mean", ["day"])
    month = masked_cells(s, d).withColumns({"day": F.year("ts"), "ts": F.trunc("ts", "month")})
    monthly = D.aggregation_label(D.valid_timesteps(month, ["day"]), "monthly", "max", ["day"])
    return hourly.unionByName(monthly).withColumnRenamed("day", "period_no")


_BANDS = [
    {"name": "cloud_fraction", "role": "context", "units": "1", "fill": 0.0, "vmin": 0.0, "vmax": 0.09},
    {"name": "value_uncertainty", "role": "quality", "units": "1"},
]

def _summary(s, d):
    """Charts of both regions, a third one over region A for which no companion was read, and a fourth of which nothing is recorded."""
    cells = _regioned(s, d)
    charts = cells.groupBy("region_id").agg(F.count_distinct("ts").alias("n_granules")).withColumn("status", F.lit("verified"))
    first = charts.where("region_id = 'A'")
    charts = charts.unionByName(first.withColumn("region_id", F.lit("C"))).unionByName(first.withColumns({"region_id": F.lit("D"), "status": F.lit(None).cast("string")}))
    out = D.evidence_summary(charts, D.evidence_facts(cells, _BANDS, "monthly", KEY), KEY, F.col("status").isNotNull())
    texts = F.transform("evidence", lambda e: F.concat(e["name"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("evidence", F.coalesce(F.array_join(texts, ";"), F.lit("")))


def _provenance(s, d):
    """Panels of both regions and of the hourly grid, then the rows of the two regions together and of all three."""
    stated = {"variable": "price", "units": "usd", "fill_value_source": "registry", "valid_range_source": "registry", "basis": "temporal mean"}
    cells = _regioned(s, d).withColumn("status", F.lit("verified"))
    hourly = masked_hourly(s, d).withColumn("region_id", F.lit("H"))
    third = P.panel_provenance(hourly, KEY, "hourly", "mean", bad=[2], stated={**stated, "valid_range_source": "file", "qa_status": "inferred", "qa_source": "flag_meanings"})
    both = maps.map_provenance(cells, "daily", KEY, "mean", GOOD, stated={**stated, "qa_status": F.col("status"), "qa_source": "registry", "region_type": "bounding_box"})
    pair = both.where(F.size("panels") > 1)
    panels = both.where(F.size("panels") == 1).unionByName(third)
    rows = panels.unionByName(pair).unionByName(P.merge_provenance(pair.unionByName(panels.where(F.col("panels")[0] == "H"))))
    return rows.withColumns({"panels": F.array_join("panels", ", "), "pass_rate": F.round("pass_rate", 6),
                            **{n: F.col(n).cast("double") for n in (*P.COUNTED[:3], *P.COUNTED[4:], "n_granules")}})


_PANEL = """count(checked) AS checked, count(checked) FILTER ({good}) AS passing, count(checked) FILTER (qa_flag IS NULL) AS flag_missing,
  round(sum({w}) FILTER (checked IS NOT NULL AND {good}) / sum({w}) FILTER (checked IS NOT NULL), 6) AS pass_rate,
  count(DISTINCT ts) FILTER (checked IS NOT NULL) AS n_time, count(DISTINCT i) FILTER (checked IS NOT NULL) AS n_lat, count(DISTINCT j) FILTER (checked IS NOT NULL) AS n_lon,
  count(DISTINCT ts) FILTER (value IS NOT NULL) AS n_granules, CAST(CAST(min(ts) FILTER (value IS NOT NULL) AS DATE) AS VARCHAR) AS start_date,
  CAST(CAST(max(ts) FILTER (value IS NOT NULL) AS DATE) AS VARCHAR) AS end_date"""


QUERIES = {
    "provenance": (
        _provenance,
        ctes("fx_cells", "fx_hourly", masked=MASKED, regioned=REGIONED, mh=MASKED_HOURLY,
             panel=f"""SELECT region_id AS panels, 'registry' AS valid_range_source, 'verified' AS qa_status, 'registry' AS qa_source, 'bounding_box' AS region_type, 'daily' AS c, {_PANEL.format(good="qa_flag IN (0)", w=W)} FROM regioned GROUP BY region_id
               UNION ALL SELECT 'H', 'file', 'inferred', 'flag_meanings', NULL, 'hourly', {_PANEL.format(good="qa_flag NOT IN (2)", w=W)} FROM mh""",
             named="""SELECT * EXCLUDE (c), concat(rng, ' Mean, ', n_granules, ' ', c, ' granules, ', rng) AS aggregation_label FROM (SELECT *, concat(start_date, ' to ', end_date) AS rng FROM panel)""",
             p="SELECT * EXCLUDE (rng) FROM named",
             merged="""SELECT string_agg(panels, ', ' ORDER BY panels) AS panels, CASE WHEN count(DISTINCT valid_range_source) = 1 THEN min(valid_range_source) END AS valid_range_source,
               CASE WHEN count(DISTINCT qa_status) = 1 THEN min(qa_status) END AS qa_status, CASE WHEN count(DISTINCT qa_source) = 1 THEN min(qa_source) END AS qa_source,
               CASE WHEN count(DISTINCT coalesce(region_type, '-')) = 1 THEN min(region_type) END AS region_type,
               NULL::BIGINT AS checked, NULL::BIGINT AS passing, NULL::BIGINT AS flag_missing, NULL::DOUBLE AS pass_rate, NULL::BIGINT AS n_time, NULL::BIGINT AS n_lat, NULL::BIGINT AS n_lon,
               CASE WHEN count(DISTINCT n_granules) = 1 THEN min(n_granules) END AS n_granules, CASE WHEN count(DISTINCT start_date) = 1 THEN min(start_date) END AS start_date,
               CASE WHEN count(DISTINCT end_date) = 1 THEN min(end_date) END AS end_date, CASE WHEN count(DISTINCT aggregation_label) = 1 THEN min(aggregation_label) END AS aggregation_label
               FROM (SELECT *, 1 AS g FROM p WHERE panels <> 'H' UNION ALL SELECT *, 2 AS g FROM p) GROUP BY g""")
        + """SELECT * REPLACE (CAST(checked AS DOUBLE) AS checked, CAST(passing AS DOUBLE) AS passing, CAST(flag_missing AS DOUBLE) AS flag_missing, CAST(n_time AS DOUBLE) AS n_time, CAST(n_lat AS DOUBLE) AS n_lat,
        CAST(n_lon AS DOUBLE) AS n_lon, CAST(n_granules AS DOUBLE) AS n_granules), 'price' AS variable, 'usd' AS units, 'registry' AS fill_value_source, 'temporal mean' AS basis FROM (FROM p UNION ALL BY NAME FROM merged)""",
    ),
    "valid_timesteps": (
        lambda s, d: as_text(D.valid_timesteps(_regioned(s, d), KEY), "ts"),
        _sql("SELECT DISTINCT region_id, CAST(ts AS VARCHAR) AS ts FROM regioned WHERE value IS NOT NULL"),
    ),
    "cadence_weights": (
        lambda s, d: as_text(r6(D.cadence_weights(D.valid_timesteps(_regioned(s, d), KEY), "monthly", KEY), "weight"), "ts"),
        _sql("""SELECT region_id, CAST(ts AS VARCHAR) AS ts, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY region_id, date_trunc('month', ts)), 6) AS weight
        FROM (SELECT DISTINCT region_id, ts FROM regioned WHERE value IS NOT NULL)"""),
    ),
    "temporal_mean": (
        lambda s, d: r6(_field(s, d), "value"),
        _sql("SELECT region_id, i, j, lat, lon, round(value, 6) AS value FROM (" + _ALLCELLS + ")", field=TEMPORAL_MEAN),
    ),
    "temporal_stat": (
        _temporal_stats,
        _sql("""SELECT region_id, i, j, stat, round(v, 6) AS value FROM (SELECT region_id, i, j, unnest(['median', 'max', 'min', 'std']) AS stat, unnest([med, mx, mn, sd]) AS v FROM cs)""", cs=_CELL_STATS),
    ),
    "area_weighted_mean": (
        lambda s, d: r6(D.area_weighted_mean(_field(s, d), KEY), "mean"),
        _sql(f"SELECT region_id, round(sum(value * {W}) / sum({W}), 6) AS mean FROM field GROUP BY region_id", field=TEMPORAL_MEAN),
    ),
    "values_stat": (
        lambda s, d: r6(D.spatial_stats(_field(s, d), KEY), "mean", "median", "max", "min", "std"),
        _sql("""SELECT region_id, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, round(stddev_samp(value), 6) AS std,
        count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM field GROUP BY region_id""", field=TEMPORAL_MEAN),
    ),
    "regional_statistics": (
        lambda s, d: r6(D.regional_statistics(_regioned(s, d), "monthly", KEY).drop("mean_basis", "extreme_basis", "spread_basis"), "mean", "median", "max", "min", "std"),
        _sql(f"""SELECT region_id, round(sum(value * {W}) / sum({W}), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
        round((SELECT max(value) FROM regioned r WHERE r.region_id = field.region_id), 6) AS max, round((SELECT min(value) FROM regioned r WHERE r.region_id = field.region_id), 6) AS min,
        count(value) AS n_pixels FROM field GROUP BY region_id""", field=TEMPORAL_MEAN),
    ),
    "find_peak": (
        lambda s, d: D.find_peak(_regioned(s, d), KEY),
        _sql("""SELECT region_id, value AS peak_value, lat AS peak_lat, lon AS peak_lon FROM
        (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY value DESC, i, j) AS rn FROM regioned WHERE value IS NOT NULL) WHERE rn = 1"""),
    ),
    "regional_timeseries": (
        lambda s, d: as_text(D.regional_timeseries(R.crop_bounds(masked_cells(s, d), BOXES["A"])), "ts"),
        _sql(f"""SELECT CAST(ts AS VARCHAR) AS ts, round(sum(value * {W}) / sum({W}), 6) AS value FROM regioned
        WHERE region_id = 'A' AND value IS NOT NULL GROUP BY ts"""),
    ),
    "regional_timeseries_stats": (
        _series_all,
        ctes("fx_hourly", masked=MASKED_HOURLY) + f"""SELECT CAST(ts AS VARCHAR) AS ts, stat, round(v, 6) AS value FROM (
        SELECT ts, unnest(['mean', 'median', 'max', 'min', 'std']) AS stat, unnest([sum(value * {W}) / sum({W}), quantile_cont(value, 0.5), max(value), min(value), stddev_samp(value)]) AS v
        FROM masked WHERE value IS NOT NULL GROUP BY ts) WHERE v IS NOT NULL""",
    ),
    "field_statistics": (
        lambda s, d: D.field_statistics(_field(s, d), KEY),
        _sql(f"""SELECT region_id, count(value) AS count, round(count(value) / count(*), 6) AS valid_fraction,
        CAST(printf('%.6e', sum(value * {W}) / sum({W}) FILTER (value IS NOT NULL)) AS DOUBLE) AS mean, CAST(printf('%.6e', min(value)) AS DOUBLE) AS min, CAST(printf('%.6e', max(value)) AS DOUBLE) AS max
        FROM allcells GROUP BY region_id""", field=TEMPORAL_MEAN, allcells=_ALLCELLS),
    ),
    "qa_pass_rate": (
        lambda s, d: D.qa_pass_rate(_regioned(s, d), KEY, good=GOOD),
        _sql(f"""SELECT region_id, count(checked) AS checked, count(value) AS passing, CAST(0 AS BIGINT) AS flag_missing,
        round(sum({W}) FILTER (value IS NOT NULL) / sum({W}) FILTER (checked IS NOT NULL), 6) AS pass_rate FROM regioned GROUP BY region_id"""),
    ),
    "qa_pass_rate_by_time": (
        lambda s, d: as_text(D.qa_pass_rate_by_time(_regioned(s, d), KEY, good=GOOD), "ts"),
        _sql(f"""SELECT region_id, CAST(ts AS VARCHAR) AS ts, count(checked) AS checked, count(value) AS passing, CAST(0 AS BIGINT) AS flag_missing,
        round(coalesce(sum({W}) FILTER (value IS NOT NULL), CASE WHEN count(checked) > 0 THEN 0 END) / sum({W}) FILTER (checked IS NOT NULL), 6) AS pass_rate FROM regioned GROUP BY region_id, ts"""),
    ),
    "counted_extent": (
        lambda s, d: D.counted_extent(_regioned(s, d), KEY),
        _sql("SELECT region_id, count(DISTINCT ts) AS n_time, count(DISTINCT i) AS n_lat, count(DISTINCT j) AS n_lon FROM regioned GROUP BY region_id"),
    ),
    "aggregation_label": (
        _label,
        ctes("fx_hourly", "fx_cells", mh=MASKED_HOURLY, masked=MASKED,
             v="""SELECT DISTINCT CAST(day(ts) AS INT) AS k, ts, 'hourly' AS c FROM mh WHERE value IS NOT NULL
               UNION ALL SELECT DISTINCT CAST(year(ts) AS INT), CAST(date_trunc('month', ts) AS TIMESTAMP), 'monthly' FROM masked WHERE value IS NOT NULL""",
             f="""SELECT k, c, count(*) AS n, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS s, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS e, CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) AS span FROM v GROUP BY k, c""",
             g="""SELECT *, concat(n, ' ', c, ' granule', CASE WHEN n = 1 THEN '' ELSE 's' END) AS gr, CASE WHEN s <> e THEN concat(s, ' to ', e) ELSE s END AS rng FROM f""",
             h="""SELECT *, CASE WHEN n <= 1 THEN 'Single Snapshot' WHEN c = 'monthly' AND n = 12 AND span >= 300 THEN 'Annual' WHEN c = 'hourly' AND n >= 10 AND span <= 1 THEN 'Daily' ELSE rng END AS p,
               CASE WHEN c = 'hourly' THEN 'Mean' ELSE 'Max' END AS st FROM g""")
        + """SELECT k AS period_no, n AS n_granules, s AS start_date, e AS end_date, concat(p, ' ', st, ', ', gr, ', ', rng) AS aggregation_label,
        concat(p, ' ', st, ' (', CASE WHEN left(s, 4) = left(e, 4) THEN left(s, 4) ELSE rng END, ', ', gr, ')') AS title_suffix FROM h""",
    ),
    "variable_coverage": (
        lambda s, d: r6(D.variable_coverage(_regioned(s, d), ["checked", "value", "cloud_fraction"], KEY), "valid_fraction"),
        _sql("""SELECT region_id, variable, round(v, 6) AS valid_fraction FROM (SELECT region_id, unnest(['checked', 'value', 'cloud_fraction']) AS variable,
        unnest([count(checked) / count(*), count(value) / count(*), count(cloud_fraction) / count(*)]) AS v FROM regioned GROUP BY region_id)"""),
    ),
    "evidence_summary": (
        _summary,
        _sql(f"""SELECT region_id, status, n_granules, has_evidence, evidence,
          CASE WHEN status IS NULL THEN 'nothing is recorded of this chart' WHEN NOT has_evidence THEN 'no companion band with values was read for this chart' END AS reason
          FROM (SELECT region_id, count(DISTINCT ts) AS n_granules, 'verified' AS status FROM regioned GROUP BY region_id UNION ALL
          SELECT k, (SELECT count(DISTINCT ts) FROM regioned WHERE region_id = 'A'), st FROM (VALUES ('C', 'verified'), ('D', NULL)) v(k, st)) c LEFT JOIN
          (SELECT region_id, true AS he, concat('cloud_fraction=', round(sum(c * {W}) / sum({W}) FILTER (c IS NOT NULL), 6), ';value_uncertainty=', round(sum(u * {W}) / sum({W}) FILTER (u IS NOT NULL), 6)) AS ev FROM bands GROUP BY region_id) e USING (region_id),
          LATERAL (SELECT coalesce(he, false) AS has_evidence, coalesce(ev, '') AS evidence)""",
             bands="""SELECT region_id, i, j, lat, avg(CASE WHEN cloud_fraction <> 0 AND cloud_fraction BETWEEN 0 AND 0.09 THEN cloud_fraction END) AS c, avg(value_uncertainty) AS u FROM regioned GROUP BY region_id, i, j, lat"""),
    ),
    "evidence_facts": (
        lambda s, d: D.evidence_facts(_regioned(s, d), _BANDS, "monthly", KEY),
        _sql(f"""SELECT e.region_id, e.name, e.role, 'mean' AS stat, round(e.m, 6) AS value, '1' AS units, round(e.n / e.cells, 4) AS coverage,
          CASE WHEN e.name = 'value_uncertainty' THEN round(abs(e.m / sc.m), 4) END AS pct_of_science FROM
          (SELECT region_id, 'cloud_fraction' AS name, 'context' AS role, sum(c * {W}) / sum({W}) FILTER (c IS NOT NULL) AS m, count(c) AS n, count(*) AS cells FROM bands GROUP BY region_id
           UNION ALL SELECT region_id, 'value_uncertainty', 'quality', sum(u * {W}) / sum({W}) FILTER (u IS NOT NULL), count(u), count(*) FROM bands GROUP BY region_id) e
          JOIN (SELECT region_id, sum(value * {W}) / sum({W}) AS m FROM field GROUP BY region_id) sc USING (region_id)""",
             field=TEMPORAL_MEAN,
             bands="""SELECT region_id, i, j, lat, avg(CASE WHEN cloud_fraction <> 0 AND cloud_fraction BETWEEN 0 AND 0.09 THEN cloud_fraction END) AS c, avg(value_uncertainty) AS u FROM regioned GROUP BY region_id, i, j, lat"""),
    ),
}

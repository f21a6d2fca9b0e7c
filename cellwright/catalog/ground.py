"""Registered queries: ground records and satellite against ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import HOURLY_VMAX, MASKED_HOURLY, as_text, r6
from cellwright.catalog.fixtures import ctes, fixture
from cellwright.operators import ground as G
from cellwright.operators import joint as J
from cellwright.operators import masking as M
from cellwright.plans import validation as V
from cellwright.session import settle
from cellwright.sources.survey import survey, timesteps

SID = "concat_ws('-', state_code, county_code, site_number)"
BOX = (-108.0, 27.0, -85.0, 50.0)
_IN_BOX = "CAST(latitude AS DOUBLE) BETWEEN 27 AND 50 AND CAST(longitude AS DOUBLE) BETWEEN -108 AND -85"
LADDER = "(VALUES (0, 0.0::DOUBLE), (1, 0.5), (2, 1.5), (3, 3.0), (4, 5.0)) l(step, deg)"


STANDARDS = ["click", "error", "purchase", "signup", "view"]


def _numbered(s, d):
    """Daily records, numbered by their standard within a site and date."""
    order = F.array_position(F.array(*[F.lit(x) for x in STANDARDS]), F.col("pollutant_standard")) - 1
    return fixture(s, d, "fx_daily").withColumn("record_no", order.cast("int"))


_NUMBERED = "SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], pollutant_standard) - 1 AS record_no FROM fx_daily"


def _periodic(s, d):
    return fixture(s, d, "fx_quarterly").withColumn("record_no", F.substring("pollutant_standard", 1, 1).cast("int"))


_PERIODIC = "SELECT *, CAST(left(pollutant_standard, 1) AS INT) AS record_no FROM fx_quarterly"


def _mask(cells):
    return M.mask_cells(cells, vmin=2.0, vmax=HOURLY_VMAX, bad=[2])


def _raw_codes(s, d):
    """Codes as callers pass them: numbers, placeholders, compound ids and junk."""
    m = fixture(s, d, "fx_monitors")
    n = F.col("site_key") % 6
    return m.select(
        "site_key", F.when(n == 1, "unknown").otherwise(F.col("state_code").cast("int").cast("string")).alias("state_code"),
        F.when(n == 2, " 7x").otherwise(F.col("county_code").cast("int").cast("string")).alias("county_code"),
        F.when(n == 3, F.concat_ws("-", F.lit("5"), "county_code", F.col("site_key").cast("string")))
        .when(n == 4, F.concat(F.lit("9-"), F.col("site_key").cast("string"))).otherwise(F.col("site_key").cast("string")).alias("site_number"),
    )


_CODES = """SELECT site_key, n, state_code, county_code, site_number, CASE WHEN n = 4 THEN 'malformed station id' WHEN n = 1 THEN 'placeholder state_code' WHEN n = 2 THEN 'non-numeric county_code' END AS reject_reason FROM
  (SELECT *, site_key % 6 AS n FROM fx_monitors)"""


def _summary(records, period):
    return r6(G.ground_summary(records, period), "mean", "min", "max", "peak_value", "observation_percent")


def _summary_sql(period: str, key: str, daily: bool) -> str:
    source = "fx_daily" if daily else "fx_quarterly"
    peak = "first_max_value" if daily else "coalesce(maximum_value, arithmetic_mean)"
    top = "first_max_value" if daily else "maximum_value"
    return ctes(source, rec=_NUMBERED if daily else _PERIODIC,
                k=f"SELECT *, {SID} AS site_id, {key} AS period, {peak} AS pk FROM rec") + f"""
SELECT site_id, period, min(local_site_name) AS local_site_name, min(units_of_measure) AS units, arg_min(pollutant_standard, record_no) AS pollutant_standard,
  min(sample_duration) AS sample_duration, count(*) AS n_periods, round(avg(arithmetic_mean), 6) AS mean,
  round({'CAST(NULL AS DOUBLE)' if daily else 'min(minimum_value)'}, 6) AS min, round(max({top}), 6) AS max, round(max(pk), 6) AS peak_value,
  {"CAST(arg_min(first_max_hour, record_no) FILTER (pk = mx) AS VARCHAR)" if daily else "CAST(NULL AS VARCHAR)"} AS peak_hour,
  CAST(sum(observation_count) AS BIGINT) AS observation_count, {'round(avg(observation_percent), 6)' if daily else 'CAST(NULL AS DOUBLE)'} AS observation_percent,
  {'CAST(NULL AS BIGINT)' if daily else 'CAST(sum(valid_day_count) AS BIGINT)'} AS valid_day_count, {'CAST(NULL AS BIGINT)' if daily else 'CAST(sum(required_day_count) AS BIGINT)'} AS required_day_count
FROM (SELECT *, max(pk) OVER (PARTITION BY site_id, period) AS mx FROM k) GROUP BY site_id, period"""


def _grid_points(s, d):
    return fixture(s, d, "fx_hourly").select(
        F.concat_ws("_", F.col("i").cast("string"), F.col("j").cast("string")).alias("query_id"), "lat", "lon").distinct()


_POINTS = "SELECT DISTINCT concat(i, '_', j) AS query_id, lat, lon FROM fx_hourly"
_SEARCH = f"""SELECT p.query_id, p.lat, p.lon, l.step, m.*, CAST(m.latitude AS DOUBLE) AS mlat, CAST(m.longitude AS DOUBLE) AS mlon FROM points p, {LADDER}, fx_monitors m
  WHERE CAST(m.latitude AS DOUBLE) BETWEEN p.lat - 0.25 - l.deg AND p.lat + 0.25 + l.deg AND CAST(m.longitude AS DOUBLE) BETWEEN p.lon - 0.25 - l.deg AND p.lon + 0.25 + l.deg"""
_CHOSEN = """SELECT query_id, coalesce(min(step) FILTER (n >= 3), arg_min(step, [-n, step])) AS step FROM (SELECT query_id, step, count(*) AS n FROM hits GROUP BY query_id, step) GROUP BY query_id"""


def _search(s, d):
    p = _grid_points(s, d)
    q = F.lit(0.25)
    boxes = p.select("query_id", (F.col("lat") - q).alias("south"), (F.col("lat") + q).alias("north"), (F.col("lon") - q).alias("west"), (F.col("lon") + q).alias("east"))
    return G.monitor_search(boxes, fixture(s, d, "fx_monitors"), 3).select("query_id", "step", "site_number")


_NEAR = """SELECT site_id, lat, lon FROM (SELECT m.site_id, a.lat, row_number() OVER (PARTITION BY m.site_id ORDER BY abs(a.lat - m.mlat), a.lat DESC) AS r1 FROM mon m, (SELECT DISTINCT lat FROM fx_hourly) a) x
  JOIN (SELECT m.site_id, a.lon, row_number() OVER (PARTITION BY m.site_id ORDER BY abs(a.lon - m.mlon), a.lon DESC) AS r2 FROM mon m, (SELECT DISTINCT lon FROM fx_hourly) a) y USING (site_id) WHERE r1 = 1 AND r2 = 1"""
_MON = f"SELECT *, {SID} AS site_id, CAST(latitude AS DOUBLE) AS mlat, CAST(longitude AS DOUBLE) AS mlon FROM fx_monitors"
_MON_BOX = _MON + f" WHERE {_IN_BOX}"
_ROWS = "SELECT n.site_id, m.ts, m.value, m.checked FROM near n JOIN masked m USING (lat, lon)"
_GROUND = f"SELECT {SID} AS site_id, date_local AS date, round(avg(arithmetic_mean), 6) AS ground FROM fx_daily GROUP BY 1, 2"
_PAIRS = """SELECT site_id, date, satellite, ground FROM (SELECT site_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, avg(value) AS satellite FROM rows_ WHERE value IS NOT NULL GROUP BY 1, 2) JOIN ground USING (site_id, date)"""
_R = "CASE WHEN count(*) >= 2 AND min(satellite) < max(satellite) AND min(ground) < max(ground) THEN corr(satellite, ground) END"


_COVERAGE = """SELECT DISTINCT m.site_id, (SELECT count(DISTINCT ts) FROM fx_hourly) AS n_total, coalesce(v.n, 0) AS n_valid
  FROM mon m LEFT JOIN (SELECT site_id, count(DISTINCT ts) AS n FROM rows_ WHERE value IS NOT NULL GROUP BY site_id) v ON v.site_id = m.site_id"""


_UNITS = "CASE WHEN CAST(split_part(site_id, '-', 3) AS INT) % 3 = 0 THEN 'ppm' ELSE 'ppb' END"


def _jsql(body: str, mon: str = _MON, **extra: str) -> str:
    return ctes("fx_hourly", "fx_monitors", "fx_daily", masked=MASKED_HOURLY, mon=mon, near=_NEAR, rows_=_ROWS, ground=_GROUND, pairs=_PAIRS, **extra) + body


def _rows(s, d):
    return _mask(J.at_monitors(fixture(s, d, "fx_monitors"), fixture(s, d, "fx_hourly")))


def _curved(s, d):
    """The daily grid bent so that both coordinates depend on row and column."""
    c = fixture(s, d, "fx_cells")
    return c.select("i", "j", (F.col("lat") + F.col("j") / F.lit(997.0)).alias("lat"), (F.col("lon") + F.col("i") * F.col("j") / F.lit(9973.0)).alias("lon"))


def _coverage(s, d):
    cells, monitors = fixture(s, d, "fx_hourly"), fixture(s, d, "fx_monitors")
    grid = survey(cells)
    return J.series_coverage(_mask(J.at_monitors(monitors, cells, grid)), monitors, timesteps(grid))


def _pairs(s, d):
    return J.pair_daily(_rows(s, d), V.daily_means(_numbered(s, d))).drop("ground_units")


def _validate(s, d):
    """Every third site reports in other units."""
    records = _numbered(s, d).withColumn("units_of_measure", F.when(F.col("site_number").cast("int") % 3 == 0, "ppm").otherwise("ppb"))
    got = V.validate_against_ground(fixture(s, d, "fx_hourly"), fixture(s, d, "fx_monitors"), records, _mask, BOX, 3, units="mol/m2")
    return r6(got, "r", "coverage_fraction", "series_coverage").withColumns({n: F.col(n).cast("double") for n in ("n_total", "n_valid", "n_excluded")})


def _overlay(s, d):
    records = settle(G.filter_standard(fixture(s, d, "fx_daily"), "click"), "records")
    return as_text(V.exceedance_overlay(fixture(s, d, "fx_hourly"), fixture(s, d, "fx_monitors"), records, _mask, BOX, 3, hard=100.0, percentile=95.0), "ts")


def _indexed(s, d):
    """Records of one standard with an index as the feed gives it: whole numbers as text, empty for some records."""
    index = F.when(F.col("first_max_hour") % 4 > 0, F.floor(F.col("first_max_value") / 2).cast("string")).otherwise("")
    return settle(G.filter_standard(fixture(s, d, "fx_daily"), "click").withColumn("aqi", index), "records")  # read once per round of the cutoff


def _reports(s, d):
    """Three parameters, each under its own standard; the third with a limit of its own."""
    named = {"click": "Ozone 8-hour 2015", "view": "PM25 24-hour 2024", "error": "CO 8-hour 1971"}
    standard = F.col("pollutant_standard")
    for mine, theirs in named.items():
        standard = F.when(F.col("pollutant_standard") == mine, theirs).otherwise(standard)
    records = fixture(s, d, "fx_daily").withColumn("pollutant_standard", standard)
    out = None
    for code, limit in (("44201", None), ("88101", None), ("42101", 50.0)):
        one = G.exceedance_report(records, code, limit).withColumn("param_code", F.lit(code))
        out = one if out is None else out.unionByName(one)
    return r6(out, "value").drop("aqi").withColumn("triggered", F.array_join("triggered", ","))


_CUT = """SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY first_max_value) - 1 AS pos, count(*) OVER (PARTITION BY site_id) AS n FROM rec"""

QUERIES = {
    "list_states": (
        lambda s, d: G.list_states(fixture(s, d, "fx_monitors")),
        ctes("fx_monitors") + "SELECT DISTINCT state_code FROM fx_monitors",
    ),
    "normalize_site_codes": (
        lambda s, d: G.normalize_site_codes(_raw_codes(s, d)),
        ctes("fx_monitors", codes=_CODES) + """SELECT site_key, reject_reason, CASE WHEN reject_reason IS NULL THEN CASE WHEN n = 3 THEN '05' ELSE state_code END END AS state_code,
        CASE WHEN reject_reason IS NULL THEN county_code END AS county_code, CASE WHEN reject_reason IS NULL THEN site_number END AS site_number FROM codes""",
    ),
    "ground_filter": (
        lambda s, d: G.ground_filter(fixture(s, d, "fx_daily"), box=(27, 50, -108, -85)).select("site_number", "date_local", "pollutant_standard", F.lit("box").alias("by"))
        .unionByName(G.ground_filter(fixture(s, d, "fx_daily"), state_code=1, county_code="3", site_number=17).select("site_number", "date_local", "pollutant_standard", F.lit("site").alias("by")))
        .unionByName(G.ground_filter(fixture(s, d, "fx_daily"), state_code="5").select("site_number", "date_local", "pollutant_standard", F.lit("state").alias("by"))),
        ctes("fx_daily") + f"""SELECT site_number, date_local, pollutant_standard, 'box' AS "by" FROM fx_daily WHERE {_IN_BOX}
        UNION ALL SELECT site_number, date_local, pollutant_standard, 'site' FROM fx_daily WHERE state_code = '01' AND county_code = '003' AND site_number = '0017'
        UNION ALL SELECT site_number, date_local, pollutant_standard, 'state' FROM fx_daily WHERE state_code = '05'""",
    ),
    "filter_standard": (
        lambda s, d: G.filter_standard(fixture(s, d, "fx_daily"), "click").select("site_number", "date_local", "first_max_value"),
        ctes("fx_daily") + "SELECT site_number, date_local, first_max_value FROM fx_daily WHERE pollutant_standard = 'click'",
    ),
    "sample_rows": (
        lambda s, d: G.sample_rows(fixture(s, d, "fx_samples")),
        ctes("fx_samples") + f"""SELECT {SID} AS site_id, concat(date_local, ' ', time_local) AS datetime_local, date_local AS date, CAST(left(time_local, 2) AS INT) AS hour,
        sample_measurement AS value, units_of_measure AS units, sample_duration, qualifier, method, local_site_name FROM fx_samples""",
    ),
    "site_cap": (
        lambda s, d: G.site_cap(_periodic(s, d), 25),
        ctes("fx_quarterly") + f"SELECT site_id, row_number() OVER (ORDER BY site_id) <= 25 AS within FROM (SELECT DISTINCT {SID} AS site_id FROM fx_quarterly)",
    ),
    "peak_record": (
        lambda s, d: r6(G.peak_record(_numbered(s, d), "daily"), "peak_value"),
        ctes("fx_daily", rec=_NUMBERED) + f"""SELECT {SID} AS site_id, date_local AS period, round(max(first_max_value), 6) AS peak_value, arg_min(record_no, [-first_max_value, record_no]) AS peak_record_no,
        date_local AS peak_date, CAST(arg_min(first_max_hour, [-first_max_value, record_no]) AS VARCHAR) AS peak_hour FROM rec GROUP BY 1, 2""",
    ),
    "ground_summary_daily": (lambda s, d: _summary(_numbered(s, d), "daily"), _summary_sql("daily", "date_local", True)),
    "ground_summary_quarterly": (lambda s, d: _summary(_periodic(s, d), "quarterly"), _summary_sql("quarterly", "concat(year, '-Q', quarter)", False)),
    "ground_summary_annual": (
        lambda s, d: _summary(_periodic(s, d).withColumn("record_no", F.col("quarter") * 10 + F.col("record_no")), "annual"),
        _summary_sql("annual", "CAST(year AS VARCHAR)", False).replace("CAST(left(pollutant_standard, 1) AS INT) AS record_no", "quarter * 10 + CAST(left(pollutant_standard, 1) AS INT) AS record_no"),
    ),
    "summary_totals": (
        lambda s, d: G.summary_totals(_periodic(s, d), "quarterly"),
        ctes("fx_quarterly") + f"""SELECT count(DISTINCT {SID}) AS total_sites_matched, count(DISTINCT {SID}) AS sites_returned, count(DISTINCT [{SID}, concat(year, '-Q', quarter)]) AS total_periods_matched FROM fx_quarterly""",
    ),
    "percentile_cutoff": (
        lambda s, d: r6(G.percentile_cutoff(fixture(s, d, "fx_daily").withColumn("site_id", J.site_id()), "first_max_value", 90.0, ["site_id"]), "cutoff"),
        ctes("fx_daily", rec=f"SELECT *, {SID} AS site_id FROM fx_daily", c=_CUT) + "SELECT site_id, n, round(first_max_value, 6) AS cutoff FROM c WHERE pos = least(CAST(floor(n * 90.0 / 100) AS BIGINT), n - 1)",
    ),
    "exceedance_days": (
        lambda s, d: G.exceedance_days(_indexed(s, d), hard=150.0, percentile=90.0, start="2024-01-02").withColumn("triggered", F.array_join("triggered", ",")),
        ctes("fx_daily", rec=f"SELECT *, {SID} AS site, 'all' AS site_id FROM fx_daily WHERE pollutant_standard = 'click' AND date_local >= '2024-01-02'", c=_CUT,
             cut="SELECT first_max_value AS cutoff FROM c WHERE pos = least(CAST(floor(n * 90.0 / 100) AS BIGINT), n - 1)")
        + """SELECT date_local AS date, site AS site_id, first_max_value AS value, local_site_name, CAST(CASE WHEN first_max_hour % 4 > 0 THEN floor(first_max_value / 2) END AS DOUBLE) AS aqi,
        CASE WHEN first_max_value > 150 AND first_max_value >= cutoff THEN 'hard,percentile' WHEN first_max_value > 150 THEN 'hard' ELSE 'percentile' END AS triggered
        FROM rec, cut WHERE first_max_value > 150 OR first_max_value >= cutoff""",
    ),
    "exceedance_facts": (
        lambda s, d: r6(G.exceedance_facts(_indexed(s, d), hard=150.0, percentile=90.0, start="2024-01-02"), "cutoff"),
        ctes("fx_daily", rec=f"SELECT *, {SID} AS site, 'all' AS site_id FROM fx_daily WHERE pollutant_standard = 'click' AND date_local >= '2024-01-02'", c=_CUT)
        + """SELECT 'first_max_value' AS field, CAST(150 AS DOUBLE) AS hard, CAST(90 AS DOUBLE) AS percentile, (SELECT round(first_max_value, 6) FROM c WHERE pos = least(CAST(floor(n * 90.0 / 100) AS BIGINT), n - 1)) AS cutoff,
        count(*) AS records_matched, count(first_max_value) AS records_with_value, count(DISTINCT date_local) AS dates_matched, count(DISTINCT site) AS sites_matched, min(date_local) AS first_date, max(date_local) AS last_date FROM rec""",
    ),
    "exceedance_report": (
        _reports,
        ctes("fx_daily") + f"""SELECT date_local AS date, {SID} AS site_id, CASE pollutant_standard WHEN 'view' THEN round(arithmetic_mean, 6) ELSE round(first_max_value, 6) END AS value, 'hard' AS triggered, local_site_name,
        CASE pollutant_standard WHEN 'click' THEN '44201' WHEN 'view' THEN '88101' ELSE '42101' END AS param_code FROM fx_daily
        WHERE (pollutant_standard = 'click' AND first_max_value > 70) OR (pollutant_standard = 'view' AND arithmetic_mean > 35) OR (pollutant_standard = 'error' AND first_max_value > 50)""",
    ),
    "exceedance_dates": (
        lambda s, d: G.exceedance_dates(settle(fixture(s, d, "fx_daily"), "records"), hard=250.0, percentile=95.0),
        ctes("fx_daily", rec=f"SELECT *, {SID} AS site_id FROM fx_daily", c=_CUT,
             cut="SELECT site_id, first_max_value AS cutoff FROM c WHERE pos = least(CAST(floor(n * 95.0 / 100) AS BIGINT), n - 1)")
        + "SELECT DISTINCT site_id, date_local AS date FROM rec JOIN cut USING (site_id) WHERE first_max_value > 250 OR first_max_value >= cutoff",
    ),
    "monitor_search": (
        _search,
        ctes("fx_hourly", "fx_monitors", points=_POINTS, hits=_SEARCH, chosen=_CHOSEN) + "SELECT query_id, step, site_number FROM hits JOIN chosen USING (query_id, step)",
    ),
    "nearest_monitors": (
        lambda s, d: G.nearest_monitors(_grid_points(s, d), fixture(s, d, "fx_monitors"), 3),
        ctes("fx_hourly", "fx_monitors", points=_POINTS, hits=_SEARCH, chosen=_CHOSEN,
             dist="""SELECT h.*, 2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(mlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(mlat)) * pow(sin(radians(mlon - lon) / 2), 2)))) AS dd FROM hits h JOIN chosen USING (query_id, step)""",
             rk=f"SELECT *, {SID} AS station_id, row_number() OVER (PARTITION BY query_id ORDER BY dd, {SID}) AS rank FROM dist")
        + "SELECT query_id, CAST(rank AS INT) AS rank, station_id, mlat AS latitude, mlon AS longitude, round(dd, 3) AS distance_miles FROM rk WHERE rank <= 3",
    ),
    "join_flag": (
        lambda s, d: as_text(J.join_flag(fixture(s, d, "fx_hourly").select("i", "j", "ts", "raw_value"), fixture(s, d, "fx_hourly").where("qa_flag > 0").select("i", "j", "ts", "qa_flag")), "ts"),
        ctes("fx_hourly") + "SELECT i, j, CAST(ts AS VARCHAR) AS ts, raw_value, qa_flag FROM fx_hourly WHERE qa_flag > 0",
    ),
    "nearest_cell": (
        lambda s, d: J.nearest_cell(fixture(s, d, "fx_monitors"), survey(fixture(s, d, "fx_hourly"))).select("site_id", "cell_lat", "cell_lon"),
        _jsql("SELECT site_id, lat AS cell_lat, lon AS cell_lon FROM near"),
    ),
    "monitor_series": (
        lambda s, d: as_text(_rows(s, d).select("site_id", "ts", "value"), "ts"),
        _jsql("SELECT site_id, CAST(ts AS VARCHAR) AS ts, value FROM rows_"),
    ),
    "nearest_swath_cell": (
        lambda s, d: r6(J.nearest_swath_cell(fixture(s, d, "fx_monitors"), _curved(s, d)).select("site_id", "i", "j", "cell_lat", "cell_lon"), "cell_lat", "cell_lon"),
        ctes("fx_cells", "fx_monitors", mon=_MON, bent="SELECT DISTINCT i, j, lat + j / CAST(997 AS DOUBLE) AS lat, lon + i * j / CAST(9973 AS DOUBLE) AS lon FROM fx_cells",
             far="""SELECT site_id, i, j, lat, lon, round(2 * 3958.8 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - mlat) / 2), 2) + cos(radians(mlat)) * cos(radians(lat)) * pow(sin(radians(lon - mlon) / 2), 2)))), 9) AS d FROM mon, bent""")
        + """SELECT site_id, i, j, round(lat, 6) AS cell_lat, round(lon, 6) AS cell_lon FROM far QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, lat DESC, lon DESC) = 1""",
    ),
    "series_coverage": (
        lambda s, d: r6(_coverage(s, d), "coverage_fraction"),
        _jsql(f"SELECT site_id, n_total, n_valid, n_total - n_valid AS n_excluded, round(n_valid / n_total, 6) AS coverage_fraction FROM ({_COVERAGE})"),
    ),
    "pair_daily": (
        lambda s, d: r6(_pairs(s, d), "satellite", "ground"),
        _jsql("SELECT site_id, date, round(satellite, 6) AS satellite, round(ground, 6) AS ground FROM pairs"),
    ),
    "correlation_stats": (
        lambda s, d: r6(J.correlation_stats(_pairs(s, d), V.daily_means(_numbered(s, d))), "r", "coverage_fraction"),
        _jsql(f"SELECT site_id, round({_R}, 6) AS r, count(*) AS n, round(count(*) / (SELECT count(*) FROM ground g WHERE g.site_id = pairs.site_id), 6) AS coverage_fraction FROM pairs GROUP BY site_id"),
    ),
    "pooled_correlation": (
        lambda s, d: r6(J.correlation_stats(_pairs(s, d), None, ()), "r", "coverage_fraction"),
        _jsql(f"SELECT round({_R}, 6) AS r, count(*) AS n, CAST(1 AS DOUBLE) AS coverage_fraction FROM pairs"),
    ),
    "validate_against_ground": (
        _validate,
        _jsql(f""", s AS (SELECT site_id, round({_R}, 6) AS r, count(*) AS n, round(count(*) / (SELECT count(*) FROM ground g WHERE g.site_id = pairs.site_id), 6) AS coverage_fraction
        FROM pairs GROUP BY site_id)
        SELECT site_id, r, coalesce(n, 0) AS n, coalesce(coverage_fraction, 0) AS coverage_fraction, CAST(n_total AS DOUBLE) AS n_total, CAST(n_valid AS DOUBLE) AS n_valid,
        CAST(n_total - n_valid AS DOUBLE) AS n_excluded, round(n_valid / n_total, 6) AS series_coverage, gu.u AS ground_units, 'mol/m2' AS satellite_units FROM ({_COVERAGE}) LEFT JOIN s USING (site_id)
        LEFT JOIN (SELECT DISTINCT site_id, {_UNITS} AS u FROM ground) gu USING (site_id)
        UNION ALL SELECT NULL, round({_R}, 6), count(*), 1, NULL, NULL, NULL, NULL, string_agg(DISTINCT {_UNITS}, ', ' ORDER BY {_UNITS}), 'mol/m2' FROM pairs HAVING count(*) > 0""", _MON_BOX),
    ),
    "exceedance_overlay": (
        _overlay,
        _jsql("""SELECT site_id, CAST(ts AS VARCHAR) AS ts, value, (site_id, CAST(CAST(ts AS DATE) AS VARCHAR)) IN (SELECT (site_id, date) FROM dates) AS exceeded FROM rows_ WHERE site_id IN (SELECT site_id FROM dates)""", _MON_BOX,
              rec=f"SELECT *, {SID} AS site_id FROM fx_daily WHERE pollutant_standard = 'click'", c=_CUT,
              dates="SELECT DISTINCT site_id, date_local AS date FROM rec JOIN (SELECT site_id, first_max_value AS cutoff FROM c WHERE pos = least(CAST(floor(n * 95.0 / 100) AS BIGINT), n - 1)) USING (site_id) WHERE first_max_value > 100 OR first_max_value >= cutoff"),
    ),
}

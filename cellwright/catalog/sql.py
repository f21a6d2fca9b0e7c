"""Registered queries: operators called from SQL over temporary views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright import sql
from cellwright.catalog._common import MASKED_HOURLY, W, as_text, masked_hourly
from cellwright.catalog.fixtures import ctes, fixture

BOX = (-108.0, 27.0, -85.0, 50.0)
_AT = (37.5, -97.25, 5)
_IN = "lon BETWEEN -108 AND -85 AND lat BETWEEN 27 AND 50"


def _installed(s, d):
    masked_hourly(s, d).createOrReplaceTempView("sql_cells")
    fixture(s, d, "fx_monitors").createOrReplaceTempView("sql_monitors")
    sql.install(s, "sql_cells", "sql_monitors", "cw_")
    return ", ".join(f"{x}D" for x in BOX)


def _series(s, d):
    box = _installed(s, d)
    rows = [f"SELECT '{stat}' AS stat, ts, value FROM cw_regional_timeseries('{stat}', {box})" for stat in ("mean", "median", "std")]
    return as_text(s.sql(" UNION ALL ".join(rows)), "ts")


def _rates(s, d):
    box = _installed(s, d)
    return s.sql(f"SELECT 'box' AS region, * FROM cw_qa_pass_rate(NULL, array(2), {box}) UNION ALL SELECT 'all', * FROM cw_qa_pass_rate(array(0, 1), NULL, NULL, NULL, NULL, NULL)")


def _near(s, d):
    _installed(s, d)
    return s.sql("SELECT * FROM cw_nearest_monitors({}, {}, {})".format(*_AT)).withColumn("latitude", F.round("latitude", 6)).withColumn("longitude", F.round("longitude", 6))


_STEPS = [0.25 + s for s in (0.0, 0.5, 1.5, 3.0, 5.0)]
_HELD = ", ".join(f"count(*) FILTER (far <= {h}) AS s{n}" for n, h in enumerate(_STEPS))
_WIDTH = "CASE " + " ".join(f"WHEN s{n} >= {_AT[2]} THEN {h}" for n, h in enumerate(_STEPS)) + f" ELSE {_STEPS[-1]} END"

QUERIES = {
    "sql_regional_timeseries": (
        _series,
        ctes("fx_hourly", m=MASKED_HOURLY, b=f"SELECT * FROM m WHERE {_IN} AND value IS NOT NULL")
        + f"""SELECT 'mean' AS stat, CAST(ts AS VARCHAR) AS ts, round(sum(value * {W}) / sum({W}), 6) AS value FROM b GROUP BY b.ts UNION ALL SELECT 'median', CAST(ts AS VARCHAR), round(median(value), 6) FROM b GROUP BY b.ts
        UNION ALL SELECT 'std', CAST(ts AS VARCHAR), round(stddev_samp(value), 6) FROM b GROUP BY b.ts HAVING count(*) > 1""",
    ),
    "sql_qa_pass_rate": (
        _rates,
        ctes("fx_hourly", m=MASKED_HOURLY)
        + f"""SELECT 'box' AS region, count(checked) AS checked, count(checked) FILTER (qa_flag <> 2) AS passing, CAST(0 AS BIGINT) AS flag_missing,
        round(sum({W}) FILTER (checked IS NOT NULL AND qa_flag <> 2) / sum({W}) FILTER (checked IS NOT NULL), 6) AS pass_rate FROM m WHERE {_IN}
        UNION ALL SELECT 'all', count(checked), count(checked) FILTER (qa_flag IN (0, 1)), 0, round(sum({W}) FILTER (checked IS NOT NULL AND qa_flag IN (0, 1)) / sum({W}) FILTER (checked IS NOT NULL), 6) FROM m""",
    ),
    "sql_nearest_monitors": (
        _near,
        ctes("fx_monitors", p="SELECT concat_ws('-', state_code, county_code, site_number) AS station_id, CAST(latitude AS DOUBLE) AS la, CAST(longitude AS DOUBLE) AS lo FROM fx_monitors",
             f=f"SELECT *, greatest(abs(la - {_AT[0]}), abs(lo - {_AT[1]})) AS far, 2 * 3958.8 * asin(sqrt(pow(sin(radians(la - {_AT[0]}) / 2), 2) + cos(radians({_AT[0]})) * cos(radians(la)) * pow(sin(radians(lo - ({_AT[1]})) / 2), 2))) AS d FROM p",
             c=f"SELECT {_HELD} FROM f")
        + f"""SELECT CAST(row_number() OVER (ORDER BY d, station_id) AS INT) AS rank, station_id, round(la, 6) AS latitude, round(lo, 6) AS longitude, round(d, 3) AS distance_miles
        FROM f, c WHERE far <= {_WIDTH} QUALIFY row_number() OVER (ORDER BY d, station_id) <= {_AT[2]}""",
    ),
}

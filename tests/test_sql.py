"""SQL functions say what the Python operators say."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellwright import sql
from cellwright.operators import ground as G
from cellwright.operators import masking as M
from cellwright.operators import reductions as D
from cellwright.operators import regions as R

BOX = (5.0, 5.0, 35.0, 70.0)


@pytest.fixture(scope="module")
def cells(spark):
    inf, nan = float("inf"), float("nan")
    values = [[1.0, 2.0, None], [nan, 4.0, -999.0], [inf, 6.0, 7.0]]
    rows = [(f"2024-01-0{t}", i, j, 10.0 + 30 * i, 10.0 * (j + 1), values[i][j] if t < 4 else None, [0, 1, 2, None][(i + j + t) % 4]) for t in range(1, 5) for i in range(3) for j in range(3)]
    frame = spark.createDataFrame(rows, "ts string, i int, j int, lat double, lon double, raw_value double, qa_flag int").withColumn("ts", F.col("ts").cast("timestamp"))
    masked = M.mask_cells(frame, fill=-999.0, bad=[2])
    masked.createOrReplaceTempView("t_cells")
    assert sql.install(spark, cells="t_cells") == ["regional_timeseries", "qa_pass_rate"]
    return masked


@pytest.mark.parametrize("stat", ["mean", "median", "max", "min", "std"])
@pytest.mark.parametrize("box", [BOX, None])
def test_series(spark, cells, stat, box):
    want = D.regional_timeseries(cells if box is None else R.crop_bounds(cells, box), stat)
    bounds = "NULL, NULL, NULL, NULL" if box is None else ", ".join(map(str, box))
    got = spark.sql(f"SELECT * FROM regional_timeseries('{stat}', {bounds}) ORDER BY ts")
    assert got.collect() == want.collect()


def test_an_unknown_statistic_is_an_error(spark, cells):
    with pytest.raises(Exception, match="unknown statistic mode"):
        spark.sql("SELECT * FROM regional_timeseries('mode', NULL, NULL, NULL, NULL)").collect()


@pytest.mark.parametrize("good, bad", [([0], None), (None, [2]), ([0], [0]), (None, None)])
def test_pass_rate(spark, cells, good, bad):
    text = lambda x: "NULL" if x is None else f"array({', '.join(map(str, x))})"
    got = spark.sql(f"SELECT * FROM qa_pass_rate({text(good)}, {text(bad)}, {', '.join(map(str, BOX))})").collect()
    assert got == D.qa_pass_rate(R.crop_bounds(cells, BOX), good=good, bad=bad).collect()


def test_functions_show_what_the_view_shows(spark, cells):
    """A box reaches the reader of the view, and a view that is replaced is followed."""
    cells.limit(0).createOrReplaceTempView("t_cells")
    assert spark.sql("SELECT * FROM regional_timeseries('mean', NULL, NULL, NULL, NULL)").count() == 0
    cells.createOrReplaceTempView("t_cells")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_monitors(spark, k):
    rows = [("01", "001", f"{n:04d}", str(30 + n % 17 * 0.4), str(-100 + n % 13 * 0.7)) for n in range(60)] + [("01", "001", "9999", "", "x")]
    monitors = spark.createDataFrame(rows, "state_code string, county_code string, site_number string, latitude string, longitude string")
    monitors.createOrReplaceTempView("t_monitors")
    assert sql.install(spark, monitors="t_monitors", prefix="my_") == ["my_nearest_monitors"]
    points = spark.createDataFrame([(0, 31.0, -99.0), (1, 36.2, -92.1), (2, 0.0, 0.0)], "query_id int, lat double, lon double")
    points.createOrReplaceTempView("t_points")
    want = G.nearest_monitors(points, monitors, k).select("query_id", "rank", "station_id", "latitude", "longitude", "distance_miles").orderBy("query_id", "rank").collect()
    got = spark.sql(f"SELECT p.query_id, m.* FROM t_points p, LATERAL my_nearest_monitors(p.lat, p.lon, {k}) m ORDER BY query_id, rank").collect()
    assert got == want and {r["query_id"] for r in got} == {0, 1}
    one = spark.sql(f"SELECT * FROM my_nearest_monitors(31.0, -99.0, {k}) ORDER BY rank").collect()
    assert [tuple(r) for r in one] == [tuple(r)[1:] for r in want if r["query_id"] == 0]

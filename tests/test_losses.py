"""Rows that lack a coordinate, a time or a number stay in their results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellwright.operators import display, joint, masking, records, regions
from cellwright.operators.reductions import regional_timeseries, temporal_mean, valid_timesteps
from cellwright.sources import exports
from cellwright.sources.cells import dedup_time, scan_cube, write_cube
from cellwright.sources.places import load_regions


def test_cells_without_longitude_stay(spark):
    cells = spark.createDataFrame([(0, 10.0), (1, 200.0), (2, None)], "j int, lon double")
    got = sorted((r["j"], r["lon"]) for r in regions.normalize_longitude(cells).collect() if r["lon"] is not None)
    assert got == [(0, -160.0), (1, 10.0)]
    assert [r["j"] for r in regions.normalize_longitude(cells).where("lon IS NULL").collect()] == [2]


def test_cells_without_a_time_stay(spark):
    cells = spark.createDataFrame([("C", "a", None, 1), ("C", "b", None, 2), ("C", "c", "2024-01-01", 3)], "collection string, granule_id string, ts string, v int")
    assert sorted(r["v"] for r in dedup_time(cells).collect()) == [1, 3]


def test_nan_in_a_cube_is_missing(spark, grid, tmp_path):
    cells = grid([0, 60], [10], {"2024-01-01": [[1.0], [float("nan")]]})
    write_cube(cells, str(tmp_path / "cube"))
    back = scan_cube(spark, str(tmp_path / "cube"))
    assert sorted((r["value"] is None, r["value"]) for r in back.collect() if r["value"] is not None) == [(False, 1.0)]
    assert [r["value"] for r in regional_timeseries(back).collect()] == [1.0]


def test_one_sample_point_is_the_first_cell(spark, grid):
    cells = grid([0, 60], [10, 20], {"2024-01-01": [[1.0, 2.0], [3.0, 4.0]]})
    assert [r["value"] for r in display.sample_points(cells, max_points=1).collect()] == [1.0]


def test_a_monitor_without_stored_rows_is_reported(spark):
    cells = spark.createDataFrame([(f"2024-01-0{n}", 0, 0, 40.0, -74.0, 1.0) for n in (1, 2)] + [("2024-01-03", 1, 1, 41.0, -73.0, 2.0)],
                                  "ts string, i int, j int, lat double, lon double, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    monitors = spark.createDataFrame([("1", "1", "1", "40", "-74"), ("1", "1", "2", "40", "-73")],
                                     "state_code string, county_code string, site_number string, latitude string, longitude string")
    got = joint.series_coverage(joint.at_monitors(monitors, cells), monitors, cells.select("ts")).orderBy("site_id").collect()
    assert [(r["n_total"], r["n_valid"], r["n_excluded"]) for r in got] == [(3, 2, 1), (3, 0, 3)]


def test_every_granule_is_exported(spark):
    cells = spark.range(60).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(0).alias("i"), F.lit(0).alias("j"),
                                   F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("id").cast("double").alias("value"))
    mean = cells.groupBy("i", "j", "lat", "lon").agg(F.avg("value").alias("value"))
    table = exports.granule_table(cells, mean, "no2", "ppb")
    headers = [r["header"] for r in table.select("header").collect()]
    assert len(headers) == len(set(headers)) == 61
    wide = exports.wide_table(table, sorted(headers))
    assert wide.count() == 1 and wide.first()["mean"] == 29.5
    with pytest.raises(Exception, match="no column for granule"):
        exports.wide_table(table, headers[:50]).collect()


def test_totals_take_all_granules(spark):
    granules = spark.range(60).select(F.lit("a").alias("set"), "id", F.when(F.col("id") > 0, 1.5).alias("size_mb"))
    assert records.granule_totals(granules, ["set"]).first().asDict() == {"set": "a", "count": 60, "total_size_mb": 88.5, "unsized": 1}
    assert [r["id"] for r in records.granule_listing(granules, ["set"], "id", 3).collect()] == [0, 1, 2]


def test_products_are_masked_by_their_own_facts(spark):
    cells = spark.createDataFrame([(c, v, q) for c in "abcd" for v, q in ((-9.0, 0), (float("nan"), 0), (5.0, 0), (6.0, 1), (7.0, None), (99.0, 0))],
                                  "collection string, raw_value double, qa_flag int")
    facts = spark.createDataFrame([
        ("a", -9.0, None, 50.0, [0], None, "verified", "flag", True),
        ("b", None, 0.0, None, None, [1], "verified", "flag", False),
        ("c", -9.0, None, None, None, None, "not applied — semantics unknown", None, True),
    ], "collection string, fill_value double, valid_min double, valid_max double, qa_good_values array<int>, qa_bad_values array<int>, qa_status string, flag_variable string, flag_present boolean")
    out = masking.mask_by_facts(cells, masking.honest_qa(facts.withColumn("qa_source", F.lit("x"))))
    got = {c: (sorted(r["value"] for r in rows if r["value"] is not None), {r["qa_status"] for r in rows})
           for c in "abcd" for rows in [[r for r in out.collect() if r["collection"] == c]]}
    assert got == {
        "a": ([5.0], {"verified"}),
        "b": ([5.0, 6.0, 7.0, 99.0], {masking.QA_NOT_APPLIED}),
        "c": ([5.0, 6.0, 7.0, 99.0], {masking.QA_NO_FLAG_VARIABLE}),
        "d": ([-9.0, 5.0, 6.0, 7.0, 99.0], {None}),
    }


def test_undated_cells_stay_apart_from_a_real_first_day(spark):
    cells = spark.createDataFrame([("1970-01-01", 1.0), ("1970-01-01", 2.0), (None, 6.0)], "ts string, value double").select(
        F.col("ts").cast("timestamp").alias("ts"), F.monotonically_increasing_id().cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), "value")
    cells = cells.withColumn("i", F.lit(0))
    # a month with one real timestep and one without a date: each weighs the same
    got = temporal_mean(cells, "monthly").first()["value"]
    assert got == pytest.approx((1.0 + 2.0 + 6.0) / 3)
    assert valid_timesteps(cells).count() == 2


def test_aliases_reach_the_polygon_they_stand_for(spark):
    ring = [(-100.0, 30.0), (-90.0, 30.0), (-95.0, 40.0)]
    edges = regions.polygon_edges(spark, {"united states": [ring], "conus": [ring]})
    got = {r["region_id"]: r for r in load_regions(spark, edges).collect()}
    for name in ("usa", "us", "united states", "lower 48", "contiguous us", "conus"):
        assert (got[name]["region_type"], got[name]["minx"], got[name]["maxy"]) == ("polygon", -100.0, 40.0)
    assert (got["usa"]["polygon_id"], got["lower 48"]["polygon_id"]) == ("united states", "conus")
    assert got["asia"]["region_type"] == "bounding_box"

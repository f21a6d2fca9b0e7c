import pytest
from pyspark.sql import functions as F

from cellwright.operators import records as L
from cellwright.operators import regions as R
from cellwright.session import fresh_path
from cellwright.sources import cells as S
from cellwright.sources import places as P
from cellwright.sources import records as Q


@pytest.fixture(scope="module")
def wide_grid(spark):
    n = 90
    return spark.range(n * n * 2).select(
        F.lit("C").alias("collection"), F.concat(F.lit("g"), (F.col("id") / (n * n)).cast("int").cast("string")).alias("granule_id"),
        F.timestamp_seconds(1704067200 + (F.col("id") / (n * n)).cast("int") * 3600).alias("ts"),
        (F.col("id") / n % n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.lit(None).cast("double").alias("level"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("value"), F.lit(0).alias("qa_flag"),
    ).withColumns({"lat": F.col("i") * 0.5, "lon": F.col("j") * 0.5})


def test_a_box_reads_only_the_tiles_it_touches(spark, wide_grid):
    path = fresh_path(spark, "cube")
    S.write_cube(wide_grid, path, tile=32)
    box = (0.0, 0.0, 10.0, 10.0)
    cropped = S.scan_cube(spark, path, box)
    assert cropped.count() == 21 * 21 * 2
    assert cropped.select(F.input_file_name().alias("f")).where(~F.contains("f", F.lit("tile_i=0/tile_j=0"))).count() == 0
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(cropped) < files(S.scan_cube(spark, path))
    assert S.scan_cube(spark, path, box, start="2024-01-01 01:00:00", collections=["C"]).count() == 21 * 21
    assert S.scan_cube(spark, path, collections=["D"]).count() == 0


def test_decoded_nan_becomes_null(spark, wide_grid):
    path = fresh_path(spark, "cells")
    wide_grid.write.parquet(path)
    cells = S.scan_cells(spark, path, box=(0.0, 0.0, 1.0, 1.0))
    assert cells.where(F.isnan("value")).count() == 0 and cells.where("value IS NULL").count() > 0
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lon), GreaterThanOrEqual(lat,0.0)" in plan


def test_first_granule_per_time_is_kept_by_name(spark):
    rows = [("C", "b", "t1", 1), ("C", "a", "t1", 2), ("C", "a", "t1", 3), ("C", "z", "t0", 4), ("D", "q", "t1", 5)]
    df = spark.createDataFrame(rows, "collection string, granule_id string, ts string, v int")
    assert sorted(r["v"] for r in S.dedup_time(df).collect()) == [2, 3, 4, 5]
    assert {(r["collection"], r["kept"], r["duplicates"]) for r in S.duplicate_report(df).collect()} == {("C", 2, 1), ("D", 1, 0)}


def test_a_real_time_is_never_overwritten(spark):
    rows = [("2024-01-01 10:30:00", "2024-01-01", None), (None, "2024-01-02", "05:00:00Z"), (None, "2024-01-02", None), (None, "junk", None), (None, None, "01:00:00")]
    df = spark.createDataFrame(rows, "ts string, range_beginning_date string, range_beginning_time string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [str(r["ts"]) if r["ts"] else None for r in S.synthesize_time(df).collect()]
    assert got == ["2024-01-01 10:30:00", "2024-01-02 05:00:00", "2024-01-02 00:00:00", None, None]


def test_point_series_of_any_span(spark):
    df = spark.createDataFrame([("2024-01-02", 1.23456789), ("2024-01-01", None), ("2024-01-03", 2.0)], "date string, v double").withColumn("date", F.to_date("date"))
    assert [r["value"] for r in Q.scan_point_series(df, "v").collect()] == [1.234568, 2.0]
    assert Q.point_timeseries(df, "v", "2024-01-01", "2024-01-02").count() == 1
    assert Q.point_timeseries(df, "v", "2013-01-01", "2024-01-03").count() == 2


def test_places(spark):
    places = spark.createDataFrame([("The   Middle  East",), ("USA",), ("atlantis",)], "place string")
    got = {r["region_id"]: (r["name"], r["region_type"]) for r in P.resolve_places(places, P.load_regions(spark)).collect()}
    assert got == {"middle east": ("Middle East", "bounding_box"), "usa": ("United States", "bounding_box"), "atlantis": (None, None)}
    edges = R.polygon_edges(spark, {"usa": [[(-100.0, 30.0), (-90.0, 30.0), (-95.0, 40.0)]], "scandinavia": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]})
    upgraded = {r["region_id"]: r for r in P.load_regions(spark, edges).collect()}
    assert (upgraded["usa"]["region_type"], upgraded["usa"]["maxy"]) == ("polygon", 40.0)
    assert upgraded["scandinavia"]["region_type"] == "bounding_box" and len(upgraded) == 39


@pytest.mark.parametrize("text, label", [
    ("Find the nearest NO2 monitor", "GROUND"), ("show a TROPOMI map", "SATELLITE"), ("compare ground and TEMPO", "BOTH"),
    ("AQI and a satellite map", "BOTH"), ("hello\nthere", "LLM"), ("confirm the\nexceedance from satellite", "BOTH"), ("éOMI", "LLM"),
])
def test_routes(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(L.route_label("t")).collect()[0][0] == label


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_merged_turns_do_not_depend_on_the_chunk(spark, chunk):
    roles = "u a a a u a u a a".split()
    rows = [(1, n, "assistant" if r == "a" else "user", "" if n == 2 else f"t{n}") for n, r in enumerate(roles)] + [(2, 0, "assistant", "x"), (2, 7, "assistant", "y")]
    got = L.merge_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), chunk).orderBy("conv_id", "message").collect()
    assert [(r["conv_id"], r["message"], r["merged"], r["text"]) for r in got] == [
        (1, 1, 1, "t0"), (1, 2, 3, "t1\n\nt3"), (1, 3, 1, "t4"), (1, 4, 1, "t5"), (1, 5, 1, "t6"), (1, 6, 2, "t7\n\nt8"), (2, 1, 2, "x\n\ny")]


def test_scope_notes(spark):
    rows = [("2024-01-01/2024-01-01", "Los Angeles, CA", "2024-01-01T10:00", "2024-01-01", "Los Angeles, California, United States", "hourly"),
            ("2024-01-05", "Paris", "2024-01-01", "2024-01-31", "Paris, Texas", "monthly"), (None, "Rome", None, None, "Milan", None)]
    df = spark.createDataFrame(rows, "time_range string, location string, start_date string, end_date string, region_name string, cadence string")
    notes = [r["note"] for r in L.scope_audit(df).collect()]
    assert notes == [None, "2024-01-05 was wanted, 2024-01-01 to 2024-01-31 is given, from monthly data", "Rome was wanted, Milan is given"]


def test_size_gate(spark):
    gib = 1024**3
    rows = [(1, gib, False), (2, 3 * gib, False), (3, 3 * gib, True), (4, 11 * gib, True), (5, None, False), (6, None, True)]
    got = {r["k"]: r["status"] for r in L.size_gate(spark.createDataFrame(rows, "k int, bytes long, confirmed boolean"), ["k"]).collect()}
    assert got == {1: "submitted", 2: "needs_confirmation", 3: "submitted", 4: "refused", 5: "needs_confirmation", 6: "submitted"}

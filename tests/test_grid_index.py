"""The survey of a grid, appended cubes, the nearest-cell index and the polygon cover against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cellwright.operators import cellindex, cover, joint
from cellwright.operators import regions as R
from cellwright.sources import survey as V
from cellwright.sources.cells import cube_survey, dedup_time, scan_cube, write_cube

RNG = random.Random(11)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("axis, points", [
    (sorted(RNG.uniform(-90, 90) ** 3 / 8100 for _ in range(300)), [RNG.uniform(-95, 95) for _ in range(200)]),
    ([k * 0.25 for k in range(40)], [k * 0.125 - 1 for k in range(100)]),  # every second point lies between two centers
    ([5.0], [-500.0, 5.0, 700.0]),
])
def test_axis_index_equals_brute_force(spark, axis, points):
    a = spark.createDataFrame([(v,) for v in axis], "c double")
    p = spark.createDataFrame(list(enumerate(points)) + [(-1, None), (-2, points[0])], "k int, x double")
    got = {r["k"]: r["c"] for r in cellindex.nearest_on_axis(p, a, "x", "c").collect()}
    assert got.pop(-1) is None and got.pop(-2) == got[0]
    assert got == {k: min(axis, key=lambda c, x=x: (abs(c - x), -c)) for k, x in enumerate(points)}


@pytest.mark.parametrize("first", [-180.0, 0.0, 100.0])
def test_longitudes_are_compared_around_the_circle(spark, first):
    axis = sorted(first + 359.9 * RNG.random() for _ in range(150))
    points = [RNG.uniform(-180, 180) for _ in range(150)] + [179.99, -179.99, 0.0]
    around = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360)
    got = cellindex.nearest_on_axis(spark.createDataFrame(list(enumerate(points)), "k int, x double"), spark.createDataFrame([(v,) for v in axis], "c double"), "x", "c", circle=True)
    for r in got.collect():
        assert around(r["c"], r["x"]) == pytest.approx(min(around(c, r["x"]) for c in axis), abs=1e-9)


def miles(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(min(1, h)))


def test_places_of_a_swath_equal_brute_force(spark):
    """Two-dimensional coordinates across the date line and the pole, and points far away."""
    swath = [(i, j, 60 + i * 0.9 + j * 0.05, (170 + j * 0.7 + i * 0.3 + 180) % 360 - 180) for i in range(33) for j in range(40)]
    swath += [(99, k, 10.0 + k * 0.1, 20.0 + k * 0.1) for k in range(5)]
    points = [(RNG.uniform(-90, 90), RNG.uniform(-180, 180)) for _ in range(60)] + [(RNG.uniform(60, 90), RNG.uniform(165, 200)) for _ in range(60)] + [(90.0, 0.0), (-90.0, 5.0), (10.0, 20.0)]
    places = spark.createDataFrame(swath + [(7, 7, None, 3.0)], "i int, j int, lat double, lon double")
    monitors = spark.createDataFrame(list(points), "_lat double, _lon double")
    got = cellindex.nearest_place(monitors, places, ["i", "j"]).collect()
    assert len(got) == len(points)
    where = {(i, j): (a, b) for i, j, a, b in swath}
    for r in got:
        best = min(miles(r["_lat"], r["_lon"], a, b) for _, _, a, b in swath)
        assert miles(r["_lat"], r["_lon"], *where[r["i"], r["j"]]) == pytest.approx(best, abs=1e-6)


def test_ties_go_to_the_larger_coordinates(spark):
    places = spark.createDataFrame([(a, b) for a in (0.0, 1.0) for b in (0.0, 1.0)], "lat double, lon double")
    got = cellindex.nearest_place(spark.createDataFrame([(0.5, 0.5), (0.0, 0.5)], "_lat double, _lon double"), places).collect()
    assert {(r["_lat"], r["lat"], r["lon"]) for r in got} == {(0.5, 1.0, 1.0), (0.0, 0.0, 1.0)}  # a degree of longitude is shorter to the north


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A cube of hourly cells in two batches."""
    path = str(tmp_path_factory.mktemp("cube") / "c")
    write_cube(granule(spark, range(0, 3)), path, tile=8, batch="a")
    write_cube(granule(spark, range(3, 5)), path, batch="b")
    return path


def granule(spark, hours, shift=0.0):
    n = 24
    return spark.range(n * n * len(hours)).select(
        F.lit("C").alias("collection"), F.element_at(F.array(*[F.lit(h) for h in hours]), (F.col("id") / (n * n)).cast("int") + 1).alias("h"),
        (F.col("id") / n % n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"),
    ).select("collection", F.concat(F.lit("g"), "h").alias("granule_id"), F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "i", "j",
             (20 + F.col("i") * 0.5 + F.col("i") * F.col("i") / 90).alias("lat"), (-120 + F.col("j") * 0.5).alias("lon"), (F.col("i") * 100 + F.col("j") + F.col("h") + shift).cast("double").alias("value"))


def test_a_repeated_append_leaves_one_copy(spark, stored, tmp_path):
    path = str(tmp_path / "c")
    whole = granule(spark, range(5)).count()
    for batch, hours in (("a", range(0, 3)), ("b", range(3, 5)), ("b", range(3, 5)), ("a", range(0, 3)), ("again", range(0, 5)), ("next", range(4, 7))):
        write_cube(granule(spark, hours), path, tile=8, batch=batch)
    got = scan_cube(spark, path)
    assert got.count() == whole // 5 * 7 and got.select("granule_id", "i", "j").distinct().count() == whole // 5 * 7
    assert V.granules(cube_survey(spark, path)).count() == 7 and V.timesteps(cube_survey(spark, path)).count() == 7
    # a batch that is sent once more with other values replaces itself
    write_cube(granule(spark, range(3, 5), shift=0.5), path, batch="b")
    assert scan_cube(spark, path).where("value <> floor(value)").select("granule_id").distinct().count() == 2


def test_a_batch_of_another_type_is_refused_before_anything_is_written(spark, stored):
    before = scan_cube(spark, stored).count()
    wrong = granule(spark, range(7, 8)).withColumn("value", F.lit("text")).withColumn("lat", F.col("lat").cast("float"))
    with pytest.raises(ValueError, match="lat: double and float; value: double and string"):
        write_cube(wrong, stored, batch="c")
    assert scan_cube(spark, stored).count() == before
    assert cube_survey(spark, stored).where("batch = 'c'").count() == 0


def test_a_band_that_a_batch_lacks_is_missing_there(spark, tmp_path):
    path = str(tmp_path / "c")
    write_cube(granule(spark, range(1)).withColumn("band", F.lit(1.0)), path, tile=8, batch="a")
    write_cube(granule(spark, range(1, 2)), path, batch="b")
    got = {r["granule_id"]: r["n"] for r in scan_cube(spark, path).groupBy("granule_id").agg(F.count("band").alias("n")).collect()}
    assert got == {"g0": 576, "g1": 0}


def test_a_box_and_a_time_read_only_their_folders(spark, stored):
    box = (-120.0, 20.0, -117.0, 22.0)
    some = scan_cube(spark, stored, box, start="1970-01-01 03:00:00")
    assert _rows_read(some) < _rows_read(scan_cube(spark, stored, box)) < _rows_read(scan_cube(spark, stored))
    assert len(some.inputFiles()) < len(scan_cube(spark, stored, box).inputFiles())  # the other batch is not even listed
    want = scan_cube(spark, stored).where("lon <= -117 AND lat <= 22 AND ts >= '1970-01-01 03:00:00'")
    assert some.count() == want.count() > 0
    assert scan_cube(spark, stored, (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_the_survey_says_what_the_cells_say(spark, stored):
    cells, kept = scan_cube(spark, stored), cube_survey(spark, stored)
    made = V.survey(cells, 8)
    for found in (kept, made):
        for c in ("lat", "lon"):
            assert sorted(r[c] for r in V.centers(found, c).collect()) == sorted(r[c] for r in cells.select(c).distinct().collect())
        assert {r["granule_id"]: r["cells"] for r in V.granules(found).collect()} == {f"g{h}": 576 for h in range(5)}
        assert V.tiles(found).count() == 9
    axes = ["lat_min", "lat_max", "n_lat", "lon_min", "lon_max", "n_lon"]
    assert V.extents(kept).select(axes).first() == R.grid_axes(cells).select(axes).first()
    assert dedup_time(cells, V.granules(kept)).count() == cells.count()


def test_nothing_but_the_chosen_cells_is_read(spark, stored):
    """The axes come from the survey, the cells are read once, within the bounds of the monitors."""
    monitors = spark.createDataFrame([("1", "1", "1", "20.6", "-119.4"), ("1", "1", "2", "21.0", "-119.0")], "state_code string, county_code string, site_number string, latitude string, longitude string")
    cells = scan_cube(spark, stored)
    near = joint.nearest_cell(monitors, cube_survey(spark, stored))
    assert "/cells" not in plan(near) and "collect_set" not in plan(near) and "CartesianProduct" not in plan(near)
    got = joint.at_monitors(monitors, cells, cube_survey(spark, stored))
    assert plan(got).split("== Physical Plan ==")[1].count(f"{stored}/cells") == 1
    assert {(r["site_id"], r["i"], r["j"]) for r in got.collect()} == {("1-1-1", 1, 1), ("1-1-2", 2, 2)} and got.count() == 10
    read = lambda q: _rows_read(q)
    assert read(got) < cells.count() / 2


def _rows_read(df) -> int:
    """Rows that scans of cells returned, from the metrics of the executed plan."""
    df.collect()

    def walk(node) -> int:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if name.startswith("Scan") and "tile_i" in node.toString() else 0
        return own + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_the_bounds_of_a_box_reach_the_reader(spark, stored):
    cells, grid = scan_cube(spark, stored), cube_survey(spark, stored)
    for box, kind in (((-120.0, 20.0, -119.0, 21.0), "bounding_box"), ((-119.9, 20.02, -119.8, 20.05), "boundary_cells")):
        got = R.region_mask_box(cells, box, "r", grid)
        assert {r["region_type"] for r in got.collect()} == {kind}
        assert _rows_read(got) < cells.count() / 2


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if min(y1, y2) <= y <= max(y1, y2):
                if y1 == y2:
                    if min(x1, x2) <= x <= max(x1, x2):
                        return True
                else:
                    cross = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
                    if cross == x:
                        return True
                    odd ^= (y1 <= y) != (y2 <= y) and cross > x
    return odd


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_covers_of_polygons_with_holes_on_an_uneven_grid(spark, seed):
    """Large and small polygons, holes, edges along rows, over tiles, blocks and single places."""
    rng = random.Random(seed)
    lats = [20 + 0.05 * k + 0.0002 * k * k for k in range(150)]
    lons = [-120 + 0.04 * k + 0.0001 * k * k for k in range(600)]
    cells = spark.range(len(lats) * len(lons)).select((F.col("id") / len(lons)).cast("int").alias("i"), (F.col("id") % len(lons)).cast("int").alias("j"))
    cells = cells.select("i", "j", (20 + 0.05 * F.col("i") + 0.0002 * F.col("i") * F.col("i")).alias("lat"), (-120 + 0.04 * F.col("j") + 0.0001 * F.col("j") * F.col("j")).alias("lon"))
    table = {(r["i"], r["j"]): (r["lat"], r["lon"]) for r in cells.collect()}

    def ring(x, y, size, n):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        return [(x + size * rng.uniform(0.5, 1) * math.cos(t), y + size * rng.uniform(0.5, 1) * math.sin(t)) for t in turns]

    x, y = lons[300], lats[75]
    polygons = {
        "large": [ring(x, y, 9, 40), ring(x, y, 2, 9), ring(x + 1, y, 0.3, 5)], "small": [ring(x - 8, y - 3, 0.2, 6)],
        "rows": [[(lons[10], lats[5]), (lons[80], lats[5]), (lons[80], lats[40]), (lons[10], lats[40])]], "far": [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]],
    }
    got = {(r["region_id"], r["i"], r["j"]) for r in R.region_mask_polygon(cells, R.polygon_edges(spark, polygons)).collect()}
    assert got == {(k, i, j) for k, rings in polygons.items() for (i, j), (lat, lon) in table.items() if _inside(lon, lat, rings)}


def test_a_cell_is_decided_once_whatever_its_timesteps(spark, stored):
    cells, grid = scan_cube(spark, stored), cube_survey(spark, stored)
    edges = R.polygon_edges(spark, {"t": [[(-119.3, 20.2), (-117.2, 20.4), (-118.1, 23.3)]]})
    found = cover.cover(grid, edges)
    places = cells.select("i", "j", "lat", "lon").distinct().collect()
    bits = sum(bin(r[m] & (1 << 64) - 1).count("1") for r in found.collect() for m in ("m0", "m1", "m2", "m3"))
    assert bits == sum(_inside(r["lon"], r["lat"], [[(-119.3, 20.2), (-117.2, 20.4), (-118.1, 23.3)]]) for r in places) > 0
    got = R.region_mask_polygon(cells, edges, grid)
    assert got.count() == 5 * bits and _rows_read(got) < cells.count()


def test_curved_grids_are_refused(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 1.5, 3.0)], "i int, j int, lat double, lon double")
    with pytest.raises(Exception, match="one latitude per row"):
        R.region_mask_polygon(cells, R.polygon_edges(spark, {"t": [[(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]]})).collect()

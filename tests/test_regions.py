import random

import pytest
from pyspark.sql import functions as F

from cellwright.operators import masking as M
from cellwright.operators import reductions as D
from cellwright.operators import regions as R

AOI = (-74.9, 39.1, -73.1, 40.9)


@pytest.fixture(scope="module")
def continent(spark):
    """Half-degree cells, latitude 20 to 55 and longitude -125 to -60; the value is the row-major index."""
    n = 131
    return spark.range(71 * n).select(
        (F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.col("id").cast("double").alias("value"),
    ).withColumns({"lat": 20 + F.col("i") * 0.5, "lon": -125 + F.col("j") * 0.5, "ts": F.to_timestamp(F.lit("2024-01-01")), "qa_flag": F.lit(0)})


def test_crop_before_mask_equals_crop_after(continent):
    before = D.field_statistics(M.mask_cells(R.crop_bounds(continent, AOI), raw="value", vmax=6000)).collect()
    after = D.field_statistics(R.crop_bounds(M.mask_cells(continent, raw="value", vmax=6000), AOI)).collect()
    assert before == after and before[0]["count"] == 9  # three rows by three columns


def test_wrapped_longitudes_give_the_same_answer(continent):
    wrapped = continent.withColumns({"lon": F.col("lon") + 360, "collection": F.lit("C")})
    assert R.crop_bounds(wrapped, AOI).count() == 0
    fixed = R.normalize_longitude(wrapped, ["collection"])
    assert sorted(r["value"] for r in R.crop_bounds(fixed, AOI).collect()) == sorted(r["value"] for r in R.crop_bounds(continent, AOI).collect())


def test_longitudes_across_zero_are_left_alone(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 200.0)], "j int, lon double")
    assert sorted((r["j"], r["lon"]) for r in R.normalize_longitude(df).collect()) == [(0, -1.0), (1, 200.0)]


def test_row_order_and_partitioning_do_not_matter(continent):
    names = ["mean", "median", "max", "min", "std", "n_pixels"]
    a = D.regional_statistics(R.crop_bounds(continent, AOI), "daily").select(names).collect()[0]
    b = D.regional_statistics(R.crop_bounds(continent.repartition(17).orderBy(F.rand(1)), AOI), "daily").select(names).collect()[0]
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


def _inside(x, y, rings):
    """Brute force, edges included."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if min(y1, y2) <= y <= max(y1, y2):
                if y1 == y2:
                    if min(x1, x2) <= x <= max(x1, x2):
                        return True
                else:
                    cross = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
                    if cross == x:
                        return True
                    if (y1 <= y) != (y2 <= y) and cross > x:
                        odd = not odd
    return odd


def test_polygons_with_holes_and_parts_match_brute_force(spark, continent):
    rng = random.Random(3)
    star = [(-95 + rng.uniform(4, 20) * c, 38 + rng.uniform(4, 14) * s) for c, s in [(1, 0), (.7, .7), (0, 1), (-.7, .7), (-1, 0), (-.7, -.7), (0, -1), (.7, -.7)]]
    hole = [(-96.0, 37.0), (-94.0, 37.0), (-94.0, 39.0), (-96.0, 39.0)]
    part = [(-120.0, 50.0), (-110.0, 50.0), (-115.0, 54.0)]
    polygons = {"a": [star, hole, part], "b": [part]}
    got = {(r["region_id"], r["lon"], r["lat"]) for r in R.region_mask_polygon(continent, R.polygon_edges(spark, polygons)).collect()}
    cells = [(r["lon"], r["lat"]) for r in continent.collect()]
    want = {(k, x, y) for k, rings in polygons.items() for x, y in cells if _inside(x, y, rings)}
    assert got == want


def test_a_region_smaller_than_a_cell_keeps_the_cells_it_touches(spark, continent):
    tiny = {"t": [[(-100.2, 30.1), (-100.1, 30.1), (-100.1, 30.15), (-100.2, 30.15)]], "gone": [[(10.0, 1.0), (10.1, 1.0), (10.1, 1.1)]]}
    got = R.region_mask_boundary(continent, R.polygon_edges(spark, tiny)).collect()
    assert {(r["region_id"], r["lon"], r["lat"], r["region_type"]) for r in got} == {("t", -100.0, 30.0, "boundary_cells")}
    box = R.region_mask_box(continent, (-100.2, 30.1, -100.1, 30.15), "t").collect()
    assert {(r["lon"], r["lat"], r["region_type"]) for r in box} == {(-100.0, 30.0, "boundary_cells")}


def test_levels_are_never_snapped_from_outside(spark):
    df = spark.createDataFrame([(0, 10.0, 1.0), (0, 20.0, 2.0), (0, 40.0, 3.0)], "i int, level double, value double")
    pick = lambda x: [r["level"] for r in R.select_level(df, x).collect()]
    assert (pick(12), pick(15), pick(40), pick(41), pick(9)) == ([10.0], [20.0], [40.0], [], [])
    at = lambda n: [r["level"] for r in R.select_level_position(df, n).collect()]
    assert (at(0), at(2), at(3), at(1.5), at(-1)) == ([10.0], [40.0], [], [], [])
    assert R.require_choice(df).collect()[0]["refused"]
    assert not R.require_choice(df.where("level = 10")).collect()[0]["refused"]


def test_uneven_axis_is_irregular(spark):
    def kind(lats):
        rows = [("g", i, j, float(lat), float(j)) for i, lat in enumerate(lats) for j in range(3)]
        return R.grid_kind(spark.createDataFrame(rows, "g string, i int, j int, lat double, lon double"), ["g"]).collect()[0]["grid_kind"]

    assert kind([0, 1, 2, 3]) == "rectilinear" and kind([0, 5]) == "rectilinear"
    assert kind([0, 1, 2, 3.0005]) == "rectilinear" and kind([0, 1, 2, 3.01]) == "irregular"


def test_projected_grids_are_named_and_refused(spark):
    rows = [(g, i, j, None, None) for g in ("crs", "metres", "half", "bare") for i in range(3) for j in range(3)] + [("fine", i, j, i * 0.5, j * 0.5) for i in range(4) for j in range(4)]
    rows += [("swath", i, j, i + j * 0.1, j * 1.0) for i in range(3) for j in range(3)] + [("down", i, j, -i * 0.5, j * 0.5) for i in range(4) for j in range(4)]
    cells = spark.createDataFrame(rows, "g string, i int, j int, lat double, lon double")
    told = spark.createDataFrame([("crs", "utm", None, None), ("metres", None, "m", "Meters "), ("half", "", "m", "degrees"), ("fine", "utm", "m", "m")], "g string, crs string, x_units string, y_units string")
    kinds = R.grid_kind(cells, ["g"], told)
    assert {r["g"]: r["grid_kind"] for r in kinds.collect()} == {"crs": "projected", "metres": "projected", "half": "none", "bare": "none", "fine": "rectilinear", "swath": "curvilinear", "down": "rectilinear"}
    assert {r["g"] for r in R.grid_refusals(kinds).collect()} == {"crs", "metres", "swath"}
    assert {r["g"] for r in R.supported_cells(cells, kinds, ["g"]).select("g").distinct().collect()} == {"half", "bare", "fine", "down"}
    plan = kinds._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("collect_list", "collect_set", "array_agg", "lag("))


def test_a_gap_in_the_rows_is_not_an_uneven_axis(spark):
    """Positions without cells are not read as long steps."""
    rows = [("g", i, j, i * 0.25, j * 0.25) for i in (0, 1, 2, 7, 8, 9) for j in range(5)]
    assert R.grid_kind(spark.createDataFrame(rows, "g string, i int, j int, lat double, lon double"), ["g"]).first()["grid_kind"] == "rectilinear"

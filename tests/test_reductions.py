import math

import pytest
from pyspark.sql import functions as F

from cellwright.functions.aggregates import pearson
from cellwright.operators import comparison as C
from cellwright.operators import display as P
from cellwright.operators import reductions as D

DAY = "2024-01-01"


def _one(df):
    return df.collect()[0]


def test_cosine_weights(grid):
    assert _one(D.area_weighted_mean(grid([0, 60], [10, 20], {DAY: [[0.0, 0.0], [1.0, 1.0]]})))["mean"] == pytest.approx(1 / 3)


def test_missing_cells_are_left_out_not_zero(grid):
    assert _one(D.area_weighted_mean(grid([0, 60], [10, 20], {DAY: [[None, None], [1.0, 3.0]]})))["mean"] == pytest.approx(2.0)


def test_an_infinite_or_empty_field_has_no_mean(grid):
    assert _one(D.area_weighted_mean(grid([0], [0, 1], {DAY: [[float("inf"), 1.0]]})))["mean"] is None
    assert _one(D.area_weighted_mean(grid([0], [0], {DAY: [[None]]})))["mean"] is None


def test_each_cadence_bucket_counts_once(grid):
    # Two granules on the first day, one on the second: (mean(1, 3) + 8) / 2.
    cells = grid([0], [0], {"2024-01-01 00:00": [[1.0]], "2024-01-01 12:00": [[3.0]], "2024-01-02 00:00": [[8.0]]})
    assert _one(D.temporal_mean(cells, "daily"))["value"] == pytest.approx(5.0)
    assert _one(D.temporal_mean(cells, "unknown"))["value"] == pytest.approx(4.0)
    assert _one(D.temporal_mean(cells, "monthly"))["value"] == pytest.approx(4.0)


def test_weights_count_valid_granules_of_the_region(grid):
    # The second granule of day one holds nothing, so the first weighs a full day.
    cells = grid([0], [0], {"2024-01-01 00:00": [[1.0]], "2024-01-01 12:00": [[None]], "2024-01-02 00:00": [[8.0]]})
    assert _one(D.temporal_mean(cells, "daily"))["value"] == pytest.approx(4.5)
    assert D.valid_timesteps(cells).count() == 2


def test_cells_without_a_time_are_a_field_already(grid):
    cells = grid([0], [0, 1], {None: [[3.0, None]]})
    assert [r["value"] for r in D.temporal_mean(cells, "monthly").orderBy("j").collect()] == [3.0, None]


def test_a_timestep_with_only_infinite_values_is_not_valid(grid):
    cells = grid([0], [0], {"2024-01-01": [[float("inf")]], "2024-01-02": [[2.0]]})
    assert D.valid_timesteps(cells).count() == 1
    assert _one(D.temporal_mean(cells, "daily"))["value"] == 2.0


def test_an_infinite_value_counts_only_at_a_valid_timestep(grid):
    inf = float("inf")
    cells = grid([0], [0, 1], {"2024-01-01 00:00": [[inf, None]], "2024-01-01 06:00": [[inf, 1.0]], "2024-01-02 00:00": [[4.0, 3.0]], "2024-01-02 06:00": [[6.0, -inf]]})
    got = [tuple(r) for r in D.temporal_fields(cells, "daily", stats=["mean", "max", "min"]).orderBy("j").select("mean", "max", "min").collect()]
    assert got == [(inf, inf, 4.0), (-inf, 3.0, -inf)]
    early = cells.where("ts <= timestamp'2024-01-01 00:00' or ts >= timestamp'2024-01-02'").where("j = 0")
    assert _one(D.temporal_fields(early, "daily", stats=["mean", "max"]))["max"] == 6.0


def test_cells_meet_the_weights_where_they_are_read_and_are_shuffled_once(grid):
    """The weights are a written table of known size, so the cells are not shuffled to meet them; only sums per cell are."""
    cells = grid([0], [0, 1], {"2024-01-01": [[1.0, 2.0]], "2024-01-02": [[3.0, None]]})
    plan = D.temporal_mean(cells, "monthly")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")


def test_extremes_run_over_observations_and_spread_over_the_mean_field(grid):
    cells = grid([0], [0, 1], {"2024-01-01": [[1.0, 10.0]], "2024-01-02": [[5.0, 20.0]]})
    got = _one(D.regional_statistics(cells, "daily"))
    assert (got["max"], got["min"], got["mean"], got["median"], got["n_pixels"]) == (20.0, 1.0, 9.0, 9.0, 2)
    assert got["std"] == pytest.approx(math.sqrt(72))


def test_std_of_one_value_is_missing(grid):
    assert _one(D.temporal_stat(grid([0], [0], {DAY: [[4.0]]}), "std"))["value"] is None


def test_peak_prefers_the_first_cell_in_row_major_order(grid):
    cells = grid([0, 1], [10, 11], {"2024-01-01": [[1.0, 7.0], [7.0, 2.0]], "2024-01-02": [[7.0, 0.0], [0.0, 0.0]]})
    got = _one(D.find_peak(cells))
    assert (got["peak_value"], got["peak_lat"], got["peak_lon"]) == (7.0, 0.0, 10.0)


def test_series_drops_empty_steps_and_sorts(grid):
    cells = grid([0], [0], {"2024-01-03": [[3.0]], "2024-01-01": [[1.0]], "2024-01-02": [[None]]})
    rows = D.regional_timeseries(cells).collect()
    assert [(str(r["ts"])[:10], r["value"]) for r in rows] == [("2024-01-01", 1.0), ("2024-01-03", 3.0)]


def test_statistics_keep_the_peak_that_thinning_skips(spark):
    field = spark.range(40000).select(
        (F.col("id") / 200).cast("int").alias("i"), (F.col("id") % 200).cast("int").alias("j"),
    ).withColumns({"lat": F.col("i") * 0.1, "lon": F.col("j") * 0.1, "value": F.when((F.col("i") == 1) & (F.col("j") == 1), 1000.0).otherwise(1.0)})
    thin = P.thin_grid(field, max_cells=8000)
    assert thin.agg(F.max("value")).collect()[0][0] == 1.0
    assert thin.count() == 67 * 67
    assert _one(D.field_statistics(field))["max"] == 1000.0
    small = field.where("i < 10 AND j < 10")
    assert P.thin_grid(small, max_cells=8000).count() == 100


@pytest.mark.parametrize("n", [8001, 12345, 16000])
def test_sampled_points_are_the_even_spacing(spark, n):
    import numpy as np

    field = spark.range(n).select(
        (F.col("id") / 130).cast("int").alias("i"), (F.col("id") % 130).cast("int").alias("j"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1.0).alias("value"),
    )
    got = sorted(r["i"] * 130 + r["j"] for r in P.sample_points(field, max_points=8000).select("i", "j").collect())
    assert got == np.linspace(0, n - 1, 8000, dtype=int).tolist()


def test_bounds_of_constant_and_empty_fields(spark):
    constant = spark.createDataFrame([(5.0,), (5.0,)], "value double")
    zero = spark.createDataFrame([(0.0,)], "value double")
    empty = spark.createDataFrame([(None,)], "value double")
    pair = lambda df: tuple(_one(C.percentile_bounds(df)))
    assert pair(constant) == pytest.approx((4.95, 5.05))
    assert pair(zero) == (-1.0, 1.0)
    assert pair(empty) == (0.0, 1.0)
    diff = empty.select(F.col("value").alias("diff"))
    assert tuple(_one(C.diverging_bounds(diff))) == (-1.0, 1.0)


def test_difference_leaves_out_one_sided_cells(grid):
    a = D.temporal_mean(grid([0, 60], [0], {DAY: [[1.0], [None]]}), "daily")
    b = D.temporal_mean(grid([0, 60], [0], {DAY: [[4.0], [9.0]]}), "daily")
    diff = C.period_difference(a, b)
    got = _one(C.anomaly_stats(diff, 3.0))
    assert (got["n_cells"], got["mean_difference"], got["percent_change"], got["n_exceeding"], got["fraction_exceeding"]) == (1, 3.0, 300.0, 1, 1.0)


def test_percent_change_is_withheld_for_a_small_baseline(grid):
    a = D.temporal_mean(grid([0], [0, 1, 2], {DAY: [[-100.0, 100.0, 0.3]]}), "daily")
    b = D.temporal_mean(grid([0], [0, 1, 2], {DAY: [[1.0, 2.0, 3.0]]}), "daily")
    got = _one(C.anomaly_stats(C.period_difference(a, b)))
    assert got["percent_change"] is None and got["percent_change_withheld"]


def test_three_sources_are_refused(spark):
    rows = [("a", 0), ("b", 1), ("c", 2)]
    three = spark.createDataFrame([(s, n, 1.0) for s, n in rows], "source string, source_no int, value double")
    assert C.split_sources(three).count() == 0
    two = three.where("source_no < 2")
    assert {(r["source"], r["side"]) for r in C.split_sources(two, "b", "a").collect()} == {("b", "A"), ("a", "B")}
    assert {(r["source"], r["side"]) for r in C.split_sources(two, "x", "y").collect()} == {("a", "A"), ("b", "B")}


def test_pearson_of_a_constant_side_or_one_pair_is_missing(spark):
    df = spark.createDataFrame([("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", 3.0, 6.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("one", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(pearson("x", "y").alias("r")).collect()}
    assert got["up"] == pytest.approx(1.0) and got["flat"] is None and got["one"] is None


@pytest.mark.parametrize("dates, cadence, label", [
    (["2024-01-01"], "daily", "Single Snapshot Mean, 1 daily granule, 2024-01-01"),
    ([f"2024-{m:02d}-01" for m in range(1, 13)], "monthly", "Annual Mean, 12 monthly granules, 2024-01-01 to 2024-12-01"),
    ([f"2024-01-{d:02d}" for d in range(1, 13)], "monthly", "2024-01-01 to 2024-01-12 Mean, 12 monthly granules, 2024-01-01 to 2024-01-12"),
    ([f"2024-01-01 {h:02d}:00" for h in range(10)], "hourly", "Daily Mean, 10 hourly granules, 2024-01-01"),
    (["2024-01-01", "2024-01-09"], "unknown", "2024-01-01 to 2024-01-09 Mean, 2 granules, 2024-01-01 to 2024-01-09"),
])
def test_labels_claim_only_what_the_dates_show(spark, dates, cadence, label):
    ts = spark.createDataFrame([(d,) for d in dates], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    assert _one(D.aggregation_label(ts, cadence, "mean"))["aggregation_label"] == label


def test_evidence_is_a_share_of_the_science_mean(grid):
    cells = grid([0], [0, 1], {DAY: [[10.0, 30.0]]}).withColumns({"u_uncertainty": F.lit(5.0), "cloud": F.when(F.col("j") == 0, 0.2).otherwise(-9.0)})
    bands = [{"name": "u_uncertainty", "role": "quality"}, {"name": "cloud", "role": "context", "fill": -9}]
    got = {r["name"]: r for r in D.evidence_facts(cells, bands, "daily").collect()}
    assert got["u_uncertainty"]["pct_of_science"] == 0.25 and got["u_uncertainty"]["coverage"] == 1.0
    assert got["cloud"]["value"] == 0.2 and got["cloud"]["coverage"] == 0.5 and got["cloud"]["pct_of_science"] is None

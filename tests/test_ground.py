import random

import pytest
from pyspark.sql import functions as F

from cellwright.functions.scalars import haversine_miles
from cellwright.operators import comparison as C
from cellwright.operators import ground as G
from cellwright.operators import joint as J
from cellwright.plans import validation as V

DAILY = "record_no int, state_code string, county_code string, site_number string, local_site_name string, date_local string, arithmetic_mean string, first_max_value string, first_max_hour string, units_of_measure string, sample_duration string, pollutant_standard string, observation_count string, observation_percent string"


def _daily(spark, rows):
    return spark.createDataFrame([(n, "34", "019", site, f"S{site}", date, mean, top, hour, "ppb", "1 HOUR", "NO2", "24", "100") for n, (site, date, mean, top, hour) in enumerate(rows)], DAILY)


def test_daily_minimum_is_never_made_from_the_mean(spark):
    df = _daily(spark, [("0007", "2024-01-01", "5.5", "12", "3"), ("0007", "2024-01-01", "6.5", "12", "9"), ("0007", "2024-01-02", "", None, None)])
    got = {r["period"]: r for r in G.ground_summary(df, "daily").collect()}
    first = got["2024-01-01"]
    assert (first["mean"], first["min"], first["max"], first["n_periods"]) == (6.0, None, 12.0, 2)
    assert (first["peak_value"], first["peak_hour"]) == (12.0, "3")
    assert (first["observation_count"], first["observation_percent"]) == (48, 100.0)
    second = got["2024-01-02"]
    assert (second["mean"], second["max"], second["peak_value"]) == (None, None, None)


def test_summary_has_all_sites_unless_capped(spark):
    df = _daily(spark, [(f"{s:04d}", "2024-01-01", "1", "1", "0") for s in range(40)])
    assert G.ground_summary(df, "daily").count() == 40
    assert sorted(r["site_id"] for r in G.ground_summary(df, "daily", cap=25).collect()) == [f"34-019-{s:04d}" for s in range(25)]
    totals = G.summary_totals(df, "daily").collect()[0]
    assert tuple(totals) == (40, 40, 40) and tuple(G.summary_totals(df, "daily", cap=25).collect()[0]) == (40, 25, 40)
    assert sorted(r["site_id"] for r in G.site_cap(df, 25).where("within").collect()) == [f"34-019-{s:04d}" for s in range(25)] and G.site_cap(df, 25).count() == 40


@pytest.mark.parametrize("codes, want", [
    (("34", "19", "7"), ("34", "019", "0007", None)),
    (("x", None, "34-019-0007"), ("34", "019", "0007", None)),
    (("34", "19", "34-7"), (None, None, None, "malformed station id")),
    (("unknown", "19", "7"), (None, None, None, "placeholder state_code")),
    (("34", "1a", "7"), (None, None, None, "non-numeric county_code")),
    (("34", "019", "12345"), ("34", "019", "12345", None)),
])
def test_site_codes(spark, codes, want):
    df = spark.createDataFrame([codes], "state_code string, county_code string, site_number string")
    assert tuple(G.normalize_site_codes(df).collect()[0]) == want


def test_most_specific_filter_wins_and_a_half_box_is_refused(spark):
    df = _daily(spark, [("0007", "2024-01-01", "1", "1", "0"), ("0008", "2024-01-01", "1", "1", "0")])
    assert G.ground_filter(df, state_code="34", county_code="19", site_number="7").count() == 1
    assert G.ground_filter(df, site_number="34-019-0008").count() == 1
    assert G.ground_filter(df, state_code=34).count() == 2
    with pytest.raises(ValueError):
        G.ground_filter(df, box=(1, 2, None, 4))


def test_cutoff_is_a_position_not_a_percentile(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    assert G.percentile_cutoff(df, "v", 50.0).collect()[0]["cutoff"] == 3.0
    assert G.percentile_cutoff(df, "v", 100.0).collect()[0]["cutoff"] == 4.0


def test_exceedances_state_every_trigger(spark):
    df = _daily(spark, [("0007", f"2024-01-{d:02d}", "1", str(v), "0") for d, v in enumerate([10, 100, 101, 200], 1)])
    got = [(r["date"], r["triggered"]) for r in G.exceedance_days(df, hard=100.0, percentile=50.0).collect()]
    assert got == [("2024-01-03", ["hard", "percentile"]), ("2024-01-04", ["hard", "percentile"])]
    assert {r["date"] for r in G.exceedance_dates(df, percentile=75.0).collect()} == {"2024-01-04"}
    assert G.exceedance_days(df, hard=1.0, start="2024-01-02", end="2024-01-03").count() == 2
    with pytest.raises(ValueError):
        G.exceedance_days(df)


def test_exceedance_window_has_the_given_bounds(spark):
    df = _daily(spark, [("0007", "2023-01-01", "1", "9", "0"), ("0007", "2024-01-01", "1", "9", "0"), ("0007", "2024-01-02", "1", "9", "0")])
    assert G.exceedance_days(df, hard=1.0, start="2023-01-01", end="2025-01-01").count() == 3
    assert G.exceedance_days(df, hard=1.0, start="2023-01-02").count() == 2
    assert G.exceedance_days(df, hard=1.0, end="2024-01-01").count() == 2


def _monitors(spark, places):
    rows = [("01", "001", f"{k:04d}", f"M{k}", str(lat), str(lon)) for k, (lat, lon) in enumerate(places)]
    return spark.createDataFrame(rows, "state_code string, county_code string, site_number string, local_site_name string, latitude string, longitude string")


def test_nearest_monitors_match_brute_force_with_a_crowded_place(spark):
    rng = random.Random(5)
    places = [(40.0, -75.0)] * 30 + [(rng.uniform(30, 50), rng.uniform(-90, -60)) for _ in range(80)]
    points = [(f"q{k}", rng.uniform(30, 50), rng.uniform(-90, -60)) for k in range(25)] + [("hot", 40.0, -75.1), ("far", 5.0, 5.0)]
    k = 4
    df = spark.createDataFrame(points, "query_id string, lat double, lon double")
    got = {}
    for r in G.nearest_monitors(df, _monitors(spark, places), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["station_id"], r["distance_miles"]))

    import math

    def miles(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(h))

    for q, lat, lon in points:
        found = []
        for step in (0.0, 0.5, 1.5, 3.0, 5.0):
            half = 0.25 + step
            box = [n for n, (a, b) in enumerate(places) if abs(a - lat) <= half and abs(b - lon) <= half]
            if len(box) > len(found):
                found = box
            if len(found) >= k:
                break
        want = sorted((miles(lat, lon, *places[n]), f"01-001-{n:04d}") for n in found)[:k]
        assert [(r, s) for r, s, _ in sorted(got.get(q, []))] == [(n + 1, s) for n, (_, s) in enumerate(want)]


def test_haversine(spark):
    d = spark.range(1).select(haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).collect()[0]["d"]
    assert d == pytest.approx(3958.8 * 3.141592653589793)


@pytest.mark.parametrize("axis, points, want", [
    ([10.0, 20.0], [18.0, 15.0, 14.9, -5.0, 99.0, 20.0], [20.0, 20.0, 10.0, 10.0, 20.0, 20.0]),
    ([3.0], [1.0, 3.0], [3.0, 3.0]),
    ([0.0, 0.1, 5.0, 5.5, 100.0], [2.54, 2.56, 52.74, 5.25], [0.1, 5.0, 5.5, 5.5]),
])
def test_nearest_on_axis(spark, axis, points, want):
    a = spark.createDataFrame([(v,) for v in axis], "c double")
    p = spark.createDataFrame(list(enumerate(points)), "k int, x double")
    assert [r["c"] for r in C.nearest_on_axis(p, a, "x", "c").orderBy("k").collect()] == want


def test_nearest_cell_value(spark, grid):
    cells = grid([10, 20], [30, 40], {"2024-01-01": [[1.0, 2.0], [3.0, 4.0]]})
    assert [r["value"] for r in J.at_monitors(_monitors(spark, [(18, 32)]), cells).collect()] == [3.0]


def test_cube_against_one_monitor(spark, grid):
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    cells = grid([40, 41], [-74, -73], {d: [[float(n + 1), 9.0], [9.0, 9.0]] for n, d in enumerate(days)})
    monitors = _monitors(spark, [(40.1, -74.2), (41.0, -73.0)])
    rows = [(n, "01", "001", "0000", "M0", d, str(2.0 * (n + 1)), None, None, "ppb", "1 HOUR", "NO2", None, None) for n, d in enumerate(days)]
    records = spark.createDataFrame(rows + [(9, "01", "001", "0000", "M0", "2024-02-01", "7", None, None, "ppb", "1 HOUR", "NO2", None, None)], DAILY)
    got = {r["site_id"]: r for r in V.validate_against_ground(cells, monitors, records, lambda c: c, (-75.0, 39.0, -72.0, 42.0), 1).collect()}
    assert set(got) == {"01-001-0000", "01-001-0001", None}
    silent = got["01-001-0001"]  # no ground record: in the report all the same
    assert (silent["r"], silent["n"], silent["n_total"], silent["n_valid"]) == (None, 0, 3, 3)
    site = got["01-001-0000"]
    assert (round(site["r"], 9), site["n"], site["coverage_fraction"], site["n_total"], site["n_excluded"]) == (1.0, 3, 0.75, 3, 0)
    assert (got[None]["n"], got[None]["coverage_fraction"]) == (3, 1.0)


def test_overlay_keeps_only_monitors_that_exceeded(spark, grid):
    cells = grid([40, 41], [-74, -73], {"2024-01-01": [[1.0, 2.0], [3.0, None]], "2024-01-02": [[4.0, 5.0], [6.0, 7.0]]})
    monitors = _monitors(spark, [(40, -74), (41, -73)])
    rows = [(0, "01", "001", "0000", "M", "2024-01-01", "1", "50", "0", "", "", "", "", ""), (1, "01", "001", "0001", "M", "2024-01-01", "1", "150", "0", "", "", "", "", "")]
    got = V.exceedance_overlay(cells, monitors, spark.createDataFrame(rows, DAILY), lambda c: c, (-75.0, 39.0, -72.0, 42.0), 1, hard=100.0).orderBy("ts").collect()
    assert [(r["site_id"], r["value"], r["exceeded"]) for r in got] == [("01-001-0001", None, True), ("01-001-0001", 7.0, False)]


def test_a_parameter_without_a_limit_needs_one(spark):
    df = _daily(spark, [("0007", "2024-01-01", "1", "9", "0")])
    with pytest.raises(ValueError):
        G.exceedance_report(df, "99999")
    assert G.exceedance_report(df, "99999", hard=5.0).count() == 1
    assert G.exceedance_report(df, "42602", hard=5.0).count() == 0  # another standard


@pytest.mark.parametrize("k", [1, 4, 40])
def test_search_over_a_crowded_tile_and_an_empty_area(spark, monkeypatch, k):
    """Most places lie in one degree square, which is split; some boxes find nothing near, some nothing at all."""
    monkeypatch.setattr(G, "DENSE", 20)
    rng = random.Random(8)
    places = [(rng.uniform(40, 41), rng.uniform(-75, -74)) for _ in range(400)] + [(rng.uniform(30, 50), rng.uniform(-90, -60)) for _ in range(40)] + [(40.5, -74.5)] * 9
    centres = [(rng.uniform(39, 42), rng.uniform(-76, -73)) for _ in range(20)] + [(rng.uniform(25, 55), rng.uniform(-95, -55)) for _ in range(20)] + [(0.0, 0.0), (40.5, -74.5)]
    boxes = spark.createDataFrame([(q, a - 0.25, a + 0.25, o - 0.25, o + 0.25) for q, (a, o) in enumerate(centres)], "query_id int, south double, north double, west double, east double")
    got = {}
    for r in G.monitor_search(boxes, _monitors(spark, places), k).collect():
        got.setdefault(r["query_id"], (r["step"], []))[1].append(int(r["site_number"]))
    for q, (a, o) in enumerate(centres):
        held = [[n for n, (x, y) in enumerate(places) if a - 0.25 - d <= x <= a + 0.25 + d and o - 0.25 - d <= y <= o + 0.25 + d] for d in (0.0, 0.5, 1.5, 3.0, 5.0)]
        step = next((n for n, h in enumerate(held) if len(h) >= k), next(n for n, h in enumerate(held) if len(h) == len(held[-1])))
        assert (sorted(got[q][1]) if q in got else []) == sorted(held[step])
        assert q not in got or got[q][0] == step


def test_most_boxes_are_settled_by_counts_of_tiles(spark, monkeypatch):
    """Boxes in a dense area never meet single places to find their step."""
    monkeypatch.setattr(G, "DENSE", 20)
    places = [(40 + a / 40, -75 + b / 40) for a in range(40) for b in range(40)]
    boxes = spark.createDataFrame([(q, 40.2 + q / 100, 40.7 + q / 100, -74.8, -74.3) for q in range(9)], "query_id int, south double, north double, west double, east double")
    written = []
    true = G.settle
    monkeypatch.setattr(G, "settle", lambda df, label: written.append((label, true(df, label))) or written[-1][1])
    assert {r["step"] for r in G.search_steps(boxes, G._spots(_monitors(spark, places)), 5).collect()} == {0}
    steps = dict(written)["steps"]
    assert steps.where("_sure <=> _may").count() == 9

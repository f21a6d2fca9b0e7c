import pytest

from cellwright.operators import masking as M
from cellwright.operators import reductions as D


def _values(df, name="value"):
    return [r[name] for r in df.orderBy("k").collect()]


def _frame(spark, values, kind="double", name="value"):
    return spark.createDataFrame(list(enumerate(values)), f"k int, {name} {kind}")


def test_integer_fill_is_exact_and_spares_neighbours(spark):
    df = _frame(spark, [50.0, 49.99, 0.0, None, float("inf")])
    assert _values(M.fill_mask(df, 50.0)) == [None, 49.99, 0.0, None, float("inf")]
    assert _values(M.fill_mask(df, 0)) == [50.0, 49.99, None, None, float("inf")]


def test_fractional_fill_has_a_tolerance(spark):
    df = _frame(spark, [-1.5, -1.5000001, -1.51])
    assert _values(M.fill_mask(df, -1.5)) == [None, None, -1.51]


def test_float32_fill_is_compared_in_its_own_type(spark):
    df = _frame(spark, [-1e30, 2.0], "float")
    assert _values(M.fill_mask(df, -1e30)) == [None, 2.0]


def test_range_is_inclusive_and_each_bound_optional(spark):
    df = _frame(spark, [1.0, 2.0, 3.0, 4.0])
    assert _values(M.valid_range_mask(df, 2, 3)) == [None, 2.0, 3.0, None]
    assert _values(M.valid_range_mask(df, None, 3)) == [1.0, 2.0, 3.0, None]


def test_missing_flag_never_passes(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (1, 1.0, 1), (2, 1.0, None), (3, 1.0, 255)], "k int, value double, qa_flag int")
    assert _values(M.qa_mask(df, good=[0])) == [1.0, None, None, None]
    assert _values(M.qa_mask(df, bad=[1])) == [1.0, None, None, 1.0]
    assert _values(M.qa_mask(M.decode_flag_fill(df, fill=255), bad=[1])) == [1.0, None, None, None]


def test_negative_scale_swaps_packed_bounds(spark):
    row = spark.createDataFrame(
        [("cf_attrs", 0.0, 100.0, -2.0, 1.0), ("cf_attrs", 1.0, None, 2.0, None), ("umm_var", 0.0, 9.0, 5.0, 5.0), ("cf_attrs", 3.0, 4.0, None, None)],
        "valid_range_source string, valid_min double, valid_max double, scale_factor double, add_offset double",
    )
    got = [(r["valid_min"], r["valid_max"]) for r in M.scale_packed_bounds(row).collect()]
    assert got == [(-199.0, 1.0), (2.0, None), (0.0, 9.0), (3.0, 4.0)]


def test_flag_meanings_need_equal_lengths_and_known_words(spark):
    rows = [("0 1 2", "normal suspicious bad"), ("0,1", "GOOD_quality 'cloudy'"), ("0 1", "good"), ("x 1", "good bad"), (None, "good"), ("1.0", "best")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, flag_values string, flag_meanings string")
    got = M.parse_flag_meanings(df).orderBy("k").collect()
    assert [r["available"] for r in got] == [True, True, False, False, False, True]
    assert (got[0]["good_values"], got[0]["bad_values"], got[0]["ambiguous_tokens"]) == ([0], [2], ["suspicious"])
    assert (got[1]["good_values"], got[1]["bad_values"]) == ([0], [1])
    assert got[5]["good_values"] == [1]


@pytest.mark.parametrize("pinned_good, pinned_bad, meanings, proposed, status, good", [
    ([0], [1], "bad good", None, "verified", [0]),
    ([], [2], "good bad", None, "verified", None),
    ([], [], "good bad", None, "cf-deterministic", [0]),
    (None, None, "missing cloudy", None, "ambiguous — awaiting classification", None),
    (None, None, "good odd", None, "ambiguous — awaiting classification", None),
    (None, None, "good odd", ["ODD"], "inferred, not verified", [0, 1]),
    (None, None, "good", None, "not applied — semantics unknown", None),
])
def test_qa_tiers(spark, pinned_good, pinned_bad, meanings, proposed, status, good):
    schema = "pinned_good array<int>, pinned_bad array<int>, flag_values string, flag_meanings string, proposed_tokens array<string>"
    df = spark.createDataFrame([(pinned_good, pinned_bad, "0 1", meanings, proposed)], schema)
    got = M.resolve_qa(M.parse_flag_meanings(df)).collect()[0]
    assert (got["qa_status"], got["qa_good_values"]) == (status, good)


def test_pass_rate_counts_of_the_three_granule_bundle(grid):
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    cells = grid([10, 20], [30, 40], {d: [[1.0, 2.0], [3.0, 4.0]] for d in days}, {d: [[0, 1], [0, 0]] for d in days})
    masked = M.mask_cells(cells, raw="value", good=[0])
    got = D.qa_pass_rate(masked, good=[0]).collect()[0]
    assert (got["checked"], got["passing"], got["flag_missing"]) == (12, 9, 0)
    assert D.qa_pass_rate(masked).count() == 0
    extent = D.counted_extent(masked).collect()[0]
    assert (extent["n_time"], extent["n_lat"], extent["n_lon"]) == (3, 2, 2)


def test_nothing_to_check_has_counts_but_no_rate(grid):
    cells = grid([10], [30], {"2024-01-01": [[None]]}, {"2024-01-01": [[None]]})
    got = D.qa_pass_rate(M.mask_cells(cells, raw="value", good=[0]), good=[0]).collect()[0]
    assert (got["checked"], got["pass_rate"]) == (0, None)


def test_unknown_quality_is_counted_apart(grid):
    cells = grid([0], [0, 1], {"2024-01-01": [[1.0, 2.0]]}, {"2024-01-01": [[0, None]]})
    got = D.qa_pass_rate(M.mask_cells(cells, raw="value", good=[0]), good=[0]).collect()[0]
    assert (got["checked"], got["passing"], got["flag_missing"], got["pass_rate"]) == (2, 1, 1, 0.5)


def test_subset_keeps_the_flag_in_the_callers_spelling(spark):
    requests = spark.createDataFrame([(1, "vcd"), (2, "product/vcd"), (3, "vcd"), (3, "flag"), (4, "other")], "request_id int, variable string")
    registry = spark.createDataFrame([("product/flag", ["vcd"]), ("product/flag", ["vcd"])], "quality_flag_var string, leaves array<string>")
    got = {(r["request_id"], r["variable"]) for r in M.subset_variables(requests, registry).where("added").collect()}
    assert got == {(1, "flag"), (2, "product/flag")}

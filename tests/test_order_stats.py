import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.operators import order_stats


def _frame(spark, groups):
    return spark.createDataFrame([(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs], "g string, v double")


def test_quantiles_equal_numpy_for_skewed_groups(spark):
    rng = random.Random(7)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(6000)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(900)],
        "one": [4.0], "two": [1.0, 2.0], "constant": [3.0] * 50,
    }
    probs = {"p2": 0.02, "median": 0.5, "p98": 0.98}
    got = {r["g"]: r for r in order_stats.quantiles(_frame(spark, groups), ["g"], "v", probs).collect()}
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-12)


def test_non_finite_values_do_not_count_and_empty_groups_stay(spark):
    df = _frame(spark, {"a": [1.0, float("nan"), float("inf"), None, 3.0], "b": [None, float("-inf")]})
    got = {r["g"]: r for r in order_stats.quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert (got["a"]["n"], got["a"]["m"]) == (2, 2.0)
    assert (got["b"]["n"], got["b"]["m"]) == (0, None)


def test_without_keys_there_is_always_one_row(spark):
    df = _frame(spark, {"a": [5.0, 1.0, 3.0]})
    assert order_stats.quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"] == 3.0
    assert order_stats.quantiles(df.where("false"), [], "v", {"m": 0.5}).collect()[0]["m"] is None


def test_positions_pick_exact_values(spark):
    values = list(range(1000, 0, -1)) + [500] * 300
    got = order_stats.values_at(_frame(spark, {"a": values}), [], "v", {"x": lambda n: F.floor(n * 0.9), "top": lambda n: n - 1}).collect()[0]
    assert got["x"] == sorted(values)[int(len(values) * 0.9)]
    assert got["top"] == 1000


def test_ordinal_numbers_rows_across_buckets(spark):
    df = spark.createDataFrame([(i, j) for i in range(7) for j in range(i + 1)], "i int, j int").orderBy(F.rand(3))
    rows = order_stats.ordinal(df, [], F.col("i"), ["j"], "pos").orderBy("i", "j").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))


EDGES = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-300, 0.1, 0.5, 1.0 - 2**-53, 1.0, 1.0 + 2**-52, 2.0, 3.0, 1e15, 2.0**53, 1e300, 1.7976931348623157e308]


def test_doubles_and_integers_of_the_same_order(spark):
    rng = random.Random(2)
    values = EDGES + [-v for v in EDGES[1:]] + [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)]
    values += [2.0**k for k in range(-1074, 1024)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1024)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", order_stats.ordered(F.col("v")).alias("x"))
    rows = df.withColumn("back", order_stats.unordered(F.col("x"))).collect()
    assert all(r["back"] == r["v"] for r in rows)
    by_value = sorted(rows, key=lambda r: r["v"])
    assert [r["x"] for r in by_value] == sorted(r["x"] for r in rows)
    assert len({r["x"] for r in rows}) == len({r["v"] for r in rows})


def test_extreme_values_and_missing_keys(spark):
    rows = [(g, h, v) for g in (None, "a") for h in (None, 1) for v in EDGES] + [("b", 1, None), (None, 2, float("nan"))]
    got = order_stats.quantiles(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v", {"m": 0.5, "top": 1.0}).collect()
    assert {(r["g"], r["h"]): (r["n"], r["m"], r["top"]) for r in got} == {
        **{(g, h): (len(EDGES), sorted(EDGES)[8], EDGES[-1]) for g in (None, "a") for h in (None, 1)}, ("b", 1): (0, None, None), (None, 2): (0, None, None)}


def test_a_group_with_most_rows_leaves_no_large_task(spark, monkeypatch):
    """Nine tenths of the rows are one group: its rows are counted where they are read, and no task of a shuffle reads a large part of them."""
    rows = spark.range(0, 400_000, 1, 16).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 70)).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(500)) / 8).alias("v"))
    path = order_stats.settle(rows, "hot")
    read = []
    true_settle = order_stats.settle

    def watched(df, label):
        out = true_settle(df, label)
        read.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(order_stats, "settle", watched)
    before = _last_stage(spark)
    got = {r["g"]: r["m"] for r in order_stats.quantiles(path, ["g"], "v", {"m": 0.5}).collect()}
    want = path.toPandas().groupby("g")["v"].median().to_dict()
    assert got == want
    assert max(_shuffled(spark, before)) < 0.1 * 400_000  # a whole stage, not just a task
    assert len(read) == 3 and not any("SortMergeJoin" in p for p in read)


def _last_stage(spark) -> int:
    return max((s.stageId() for s in _stages(spark)), default=-1)


def _stages(spark) -> list:
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def _shuffled(spark, after: int) -> list[int]:
    """Rows that the stages since then have read from shuffles."""
    return [0, *(s.shuffleReadRecords() for s in _stages(spark) if s.stageId() > after)]

"""Provenance rows: what is kept when panels meet, in whatever order."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from cellwright.operators import masking as M
from cellwright.operators import provenance as P
from cellwright.operators import reductions as D


def _panels(spark, grid):
    days = ["2024-01-01", "2024-01-02"]
    cells = grid([10, 20], [30, 40], {d: [[1.0, 2.0], [3.0, None]] for d in days}, {d: [[0, 1], [0, 0]] for d in days})
    one = M.mask_cells(cells, raw="value", good=[0]).withColumn("region", F.lit("east"))
    two = M.mask_cells(cells.where("ts < '2024-01-02'"), raw="value", good=[0]).withColumn("region", F.lit("west"))
    three = M.mask_cells(cells, raw="value").withColumn("region", F.lit("north"))
    said = {"variable": "no2", "units": "mol", "qa_status": "verified", "qa_source": "registry", "region_type": "polygon"}
    return [P.panel_provenance(one.unionByName(two), ["region"], "daily", good=[0], stated=said),
            P.panel_provenance(three, ["region"], "daily", stated={**said, "qa_status": "not-applied", "qa_source": None})]


def test_one_row_per_panel_says_what_was_counted(spark, grid):
    rows = {r["panels"][0]: r for p in _panels(spark, grid) for r in p.collect()}
    assert (rows["east"]["checked"], rows["east"]["passing"], rows["east"]["n_time"], rows["east"]["n_granules"]) == (6, 4, 2, 2)
    assert (rows["west"]["checked"], rows["west"]["passing"], rows["west"]["aggregation_label"][:15]) == (3, 2, "Single Snapshot")
    assert rows["north"]["checked"] is None and rows["north"]["pass_rate"] is None and rows["north"]["qa_source"] is None  # no mask ran


def test_merging_keeps_what_is_true_of_all_in_any_order(spark, grid):
    panels = _panels(spark, grid)
    single = panels[0].unionByName(panels[1])
    whole = P.merge_provenance(single).collect()
    assert len(whole) == 1
    r = whole[0]
    assert r["panels"] == ["east", "north", "west"] and (r["variable"], r["units"], r["region_type"]) == ("no2", "mol", "polygon")
    assert r["qa_status"] is None and r["qa_source"] is None and r["checked"] is None and r["pass_rate"] is None and r["start_date"] == "2024-01-01" and r["end_date"] is None
    for a, b, c in itertools.permutations(["east", "west", "north"]):
        pair = P.merge_provenance(single.where(F.col("panels")[0].isin(a, b)))
        assert P.merge_provenance(pair.unionByName(single.where(F.col("panels")[0] == c))).collect() == whole
    alone = P.merge_provenance(single.where(F.col("panels")[0] == "east")).collect()
    assert alone == single.where(F.col("panels")[0] == "east").collect()


def test_facts_that_vary_inside_a_panel_are_not_claimed(spark, grid):
    cells = grid([10], [30, 40], {"2024-01-01": [[1.0, 2.0]]}).withColumns({"checked": F.col("value"), "k": F.lit("p"), "status": F.when(F.col("j") == 0, "verified")})
    row = P.panel_provenance(cells, ["k"], "daily", stated={"qa_status": F.col("status")}).first()
    assert row["qa_status"] is None


def test_charts_say_why_there_is_no_evidence(spark):
    charts = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", None)], "k string, status string")
    facts = spark.createDataFrame([("a", "cloud", "context", 1.0, "1", 0.5, None), ("c", "cloud", "context", 1.0, "1", 0.5, None)],
                                  "k string, name string, role string, value double, units string, coverage double, pct_of_science double")
    got = {r["k"]: (r["has_evidence"], r["reason"]) for r in D.evidence_summary(charts, facts, ["k"], F.col("status").isNotNull()).collect()}
    assert got["a"] == (True, None) and not got["b"][0] and "companion" in got["b"][1] and not got["c"][0] and "recorded" in got["c"][1]

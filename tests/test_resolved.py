"""Files with different bands, each read by its own variable."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellwright.operators import masking as M
from cellwright.operators import reductions as D
from cellwright.operators import resolved as V

BANDS = ["product/no2", "column_amount_o3", "aod/Mean", "cloud_fraction"]
DESCRIBED = "file_id int, ordinal int, name string, standard_name string, long_name string, units string, flag_values string, flag_meanings string"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "t")
    at = lambda n: F.col("file_id") == n
    cells = spark.range(400).select((F.col("id") % 4).cast("int").alias("file_id"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), (F.col("id") / 4 / 10).cast("int").alias("i"), ((F.col("id") / 4).cast("int") % 10).alias("j"),
                                    F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"), F.col("id").cast("double").alias("v"))
    cells.select("file_id", "ts", "i", "j", "lat", "lon", F.when(at(0), F.col("v")).alias(BANDS[0]), F.when(at(1) | (at(0) & (F.col("v") < 40)), -F.col("v")).alias(BANDS[1]),
                 F.when(at(2), F.col("v") * 2).alias(BANDS[2]), F.when(~at(3), F.lit(0.5)).alias(BANDS[3])).write.parquet(path)
    rows = [(f, n, b, None, None, "1", None, None) for f in range(4) for n, b in enumerate(BANDS)]
    return spark.read.parquet(path), spark.createDataFrame(rows, DESCRIBED)


def test_each_file_is_read_by_its_own_variable(files):
    resolved, cells = V.resolve_files(*files, BANDS)
    assert {r["file_id"]: r["variable"] for r in resolved.collect()} == {0: "product/no2", 1: "column_amount_o3", 2: "aod/Mean", 3: None}
    masked = M.mask_cells(cells, vmin=-1e9)
    got = {(r["file_id"], r["i"], r["j"]): r["value"] for r in D.temporal_mean(masked, "daily", ["file_id"]).collect()}
    assert len(got) == 300
    for k in range(400):
        if k % 4 < 3:
            assert got[k % 4, k // 4 // 10, k // 4 % 10] == [k, -k, 2 * k][k % 4]


def test_only_resolved_bands_are_read(files):
    _, cells = V.resolve_files(*files, BANDS)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "cloud_fraction" not in plan and "column_amount_o3" in plan and "raw_value" not in plan.split("ReadSchema")[1]


def test_a_variable_without_a_band_is_an_error(files, spark):
    with pytest.raises(ValueError, match="without a band: gone"):
        V.science_cells(files[0], spark.createDataFrame([(0, "gone")], "file_id int, variable string"), BANDS)


def test_no_file_and_no_cells(files):
    resolved, cells = V.resolve_files(files[0].where("false"), files[1].where("false"), BANDS)
    assert resolved.count() == 0 and cells.count() == 0 and "raw_value" in cells.columns

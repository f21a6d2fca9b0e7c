"""Shared parameters and SQL texts of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.fixtures import fixture
from cellwright.operators import masking

FILL, VMIN, VMAX, GOOD = -999.0, 2.0, 100.0, [0]
HOURLY_VMAX = 300.0
BOXES = {"A": (-115.0, 24.0, -90.0, 44.0), "B": (-100.0, 30.0, -75.0, 58.0)}
TRIANGLE = {"T": [[(-119.0, 21.0), (-76.0, 21.0), (-98.0, 57.0)]]}
SUBCELL = (-118.4, 21.1, -118.1, 21.4)


def masked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_cells(fixture(spark, sf_dir, "fx_cells"), fill=FILL, vmin=VMIN, vmax=VMAX, good=GOOD)


def masked_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_cells(fixture(spark, sf_dir, "fx_hourly"), fill=FILL, vmin=VMIN, vmax=HOURLY_VMAX, bad=[2])


MASKED = """SELECT *, CASE WHEN qa_flag IN (0) THEN checked END AS value FROM
  (SELECT *, CASE WHEN raw_value <> -999 AND raw_value BETWEEN 2 AND 100 THEN raw_value END AS checked FROM fx_cells)"""
MASKED_HOURLY = """SELECT *, CASE WHEN qa_flag NOT IN (2) THEN checked END AS value FROM
  (SELECT *, CASE WHEN raw_value <> -999 AND raw_value BETWEEN 2 AND 300 THEN raw_value END AS checked FROM fx_hourly)"""
IN_A = "lon BETWEEN -115 AND -90 AND lat BETWEEN 24 AND 44"
IN_B = "lon BETWEEN -100 AND -75 AND lat BETWEEN 30 AND 58"
REGIONED = f"""SELECT *, 'A' AS region_id FROM masked WHERE {IN_A}
  UNION ALL SELECT *, 'B' AS region_id FROM masked WHERE {IN_B}"""
W = "greatest(cos(radians(lat)), 0)"
# Cadence-weighted mean over time per (region, cell), as a CTE text over `regioned`.
TEMPORAL_MEAN = """SELECT r.region_id, r.i, r.j, r.lat, r.lon, sum(r.value * w.w) / sum(w.w) AS value
  FROM regioned r JOIN (SELECT region_id, ts, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY region_id, date_trunc('month', ts)) AS w
    FROM (SELECT DISTINCT region_id, ts FROM regioned WHERE value IS NOT NULL)) w
  ON r.region_id = w.region_id AND r.ts = w.ts
  WHERE r.value IS NOT NULL GROUP BY r.region_id, r.i, r.j, r.lat, r.lon"""


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates and times leave a query as text, so both engines print them alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})

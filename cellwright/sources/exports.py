"""CSV exports of finished results: what is exported is the result itself, masks included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import is_finite


def unique_headers(names: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique: the second of a kind ends in `_2`, the third in `_3`."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    base = F.coalesce(F.nullif(name, F.lit("")), F.lit("granule"))
    return names.withColumn("_k", k).withColumn(
        "header", F.when(F.col("_k") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("_k").cast("string")))
    ).drop("_k")


def cells_table(field: DataFrame, variable: str, units: str, panel: str | None = None) -> DataFrame:
    """(panel,) variable, latitude, longitude, value, units; finite cells only."""
    head = [F.col(panel).alias("panel")] if panel else []
    return field.where(is_finite("value")).select(
        *head, F.lit(variable).alias("variable"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        "value", F.lit(units).alias("units"),
    )


def granule_table(cells: DataFrame, mean_field: DataFrame, variable: str, units: str, panel: str | None = None) -> DataFrame:
    """One row per cell and granule with a value there, headed by the granule's date, and a row `mean` per cell.

    All granules, in long form: the file to write at scale. Its number of columns does not grow.
    """
    head = [F.col(panel).alias("panel")] if panel else []
    held = cells.where(is_finite("value"))
    first = held.select("ts").distinct().withColumn("_date", F.to_date("ts").cast("string"))
    rows = held.join(unique_headers(first, "_date", "ts").select("ts", "header"), "ts")
    means = mean_field.where(is_finite("value")).withColumn("header", F.lit("mean"))
    columns = [
        *head, F.lit(variable).alias("variable"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        "header", "value", F.lit(units).alias("units"),
    ]
    return rows.select(*columns).unionByName(means.select(*columns))


def wide_table(table: DataFrame, headers: Sequence[str]) -> DataFrame:
    """A `granule_table` with one column per header the caller names; a granule left out is an error, never a cut."""
    known = F.col("header").isin(list(headers))
    refused = F.raise_error(F.concat(F.lit("no column for granule "), F.col("header"))).cast("string")
    place = [c for c in table.columns if c not in ("header", "value")]
    named = table.withColumn("header", F.when(known, F.col("header")).otherwise(refused))
    return named.groupBy(*place).pivot("header", list(headers)).agg(F.first("value"))


def series_table(series: DataFrame, variable: str, stat: str, units: str) -> DataFrame:
    """variable, time, stat, value, units."""
    return series.select(
        F.lit(variable).alias("variable"), F.col("ts").cast("string").alias("time"), F.lit(stat).alias("stat"), "value", F.lit(units).alias("units")
    )


def write_csv(table: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write with a header; an order makes each file a sorted slice."""
    (table.orderBy(*order) if order else table).write.csv(path, header=True)

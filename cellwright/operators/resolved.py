"""Files of many products read as one table: each file's own variable as its value.

Cells carry the bands of all products as columns, named like the variables, with NULL where a file lacks a band. Their coverage is
measured in one pass, each file's variable is resolved from it (`inventory.resolve_variable`), and the cells are read once
more with nothing but the bands that some file was resolved to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators.inventory import resolve_variable
from cellwright.session import settle


def measured(described: DataFrame, cells: DataFrame, bands: Sequence[str], key: str = "file_id") -> DataFrame:
    """The described variables with `n_cells` and `n_valid` as found in the cells: one pass, one row per file before any join."""
    wide = cells.groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"), F.map_from_arrays(
        F.array(*[F.lit(b) for b in bands]), F.array(*[F.count(f"`{b}`") for b in bands])).alias("_valid"))
    rows = described.drop("n_cells", "n_valid").join(wide, key, "left")
    none = F.lit(0).cast("long")
    return rows.withColumns({"n_cells": F.coalesce("n_cells", none), "n_valid": F.coalesce(F.try_element_at("_valid", F.col("name")), none)}).drop("_valid")


def science_cells(cells: DataFrame, resolved: DataFrame, bands: Sequence[str], key: str = "file_id") -> DataFrame:
    """Cells of all files that have a variable, with its name as `variable` and its values as `raw_value`; the bands themselves are gone.

    `resolved` comes from `resolve_variable`. Files whose variable could not be told are left out here; they stay in `resolved`.
    """
    told = settle(resolved.where(F.col("variable").isNotNull()).select(key, "variable"), "resolved")
    wanted = {r["variable"] for r in told.select("variable").distinct().collect()}  # at most one per band
    unknown = sorted(wanted - set(bands))
    if unknown:
        raise ValueError(f"variables without a band: {', '.join(unknown)}")
    value = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("variable") == b, F.col(f"`{b}`").cast("double")) for b in bands if b in wanted])
    kept = [c for c in cells.columns if c not in bands]
    return cells.join(told, key).select(*kept, "variable", value.alias("raw_value"))


def resolve_files(cells: DataFrame, described: DataFrame, bands: Sequence[str], key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """What each file is about, with all alternatives, and the cells to go on with."""
    resolved = settle(resolve_variable(measured(described, cells, bands, key)), "resolution")
    return resolved, science_cells(cells, resolved, bands, key)

"""Granule cells: reading, combining, dating and tiling."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.functions.scalars import nan_to_null
from cellwright.operators.regions import Box, in_box
from cellwright.schemas import CELLS
from cellwright.session import settle
from cellwright.sources.survey import SURVEY, TILE, facts, granules, tile_of


def scan_cells(
    spark: SparkSession, path: str, bands: Sequence[str] = (), *, box: Box | None = None,
    start: str | None = None, end: str | None = None, collections: Sequence[str] | None = None,
) -> DataFrame:
    """Decoded cells from Parquet with a fixed schema; decoded NaN becomes NULL.

    Box, times and collections are plain comparisons on stored columns, so they reach the scan.
    """
    schema = T.StructType(list(CELLS.fields) + [T.StructField(b, T.DoubleType(), True) for b in bands])
    cells = spark.read.schema(schema).parquet(path)
    if collections is not None:
        cells = cells.where(F.col("collection").isin(list(collections)))
    if start is not None:
        cells = cells.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        cells = cells.where(F.col("ts") < F.to_timestamp(F.lit(end)))
    if box is not None:
        cells = cells.where(in_box(box))
    return cells.withColumns({c: nan_to_null(c) for c in ["value", *bands]})


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The survey of a written cube with the batch of each row, None before the first batch."""
    schema = T.StructType([*SURVEY.fields, T.StructField("batch", T.StringType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/survey")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _schemas(stored: DataFrame) -> dict[str, T.StructType]:
    """The schema of each batch; one row per batch."""
    rows = stored.where("kind = 'schema'").select("batch", "stored_schema").collect()
    return {r["batch"]: T.StructType.fromJson(json.loads(r["stored_schema"])) for r in rows}


def joined_schema(*schemas: T.StructType) -> T.StructType:
    """All columns of the schemas, in order; a column of two types is an error that names all of them."""
    fields: dict[str, T.StructField] = {}
    wrong = set()
    for schema in schemas:
        for f in schema:
            if fields.setdefault(f.name, f).dataType != f.dataType:
                wrong.add(f"{f.name}: {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
    if wrong:
        raise ValueError(f"columns of several types: {'; '.join(sorted(wrong))}")
    return T.StructType(list(fields.values()))


def write_cube(cells: DataFrame, path: str, tile: int = TILE, extra_keys: Sequence[str] = (), batch: str = "0") -> None:
    """Store a batch of cells by collection and spatial tile, with its survey beside it.

    The first batch makes the cube and sets its tile size, further ones are appended; a batch may lack or add bands, but a band has
    one type throughout, which is checked before anything is written. Granules that another batch holds are
    left out, and a batch that is written again replaces itself: a repeated append leaves one copy. The survey is written
    last, and only batches with a survey are read.

    Rows are range-partitioned by tile, time and place, so a tile that holds most rows is split
    over many tasks and files, and row groups have narrow coordinate ranges.
    """
    spark = cells.sparkSession
    stored = _stored(spark, path)
    if stored is not None:
        others = stored.where(F.col("batch") != batch)
        joined_schema(*_schemas(others).values(), cells.schema)
        tile = others.agg(F.max("tile")).first()[0] or tile
        held = granules(others).select("collection", "granule_id").distinct()
        cells = cells.join(held, ["collection", "granule_id"], "left_anti").select(cells.columns)
    tiled = _missing_as_null(cells).withColumns({"tile_i": tile_of("i", tile), "tile_j": tile_of("j", tile)})
    order = ["collection", "tile_i", "tile_j", "ts", "i", "j", *extra_keys]
    here = f"{path}/cells/batch={batch}"
    (
        tiled.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").partitionBy("collection", "tile_i", "tile_j").parquet(here)
    )
    found = settle(facts(spark.read.schema(tiled.schema).parquet(here), tile), "survey")
    contract = found.agg(F.lit("schema").alias("kind"), F.min("ts").alias("ts"), F.max("ts").alias("ts_to"), F.lit(cells.schema.json()).alias("stored_schema"), F.lit(tile).alias("tile"))
    found.unionByName(contract, allowMissingColumns=True).select(SURVEY.names).coalesce(1).write.mode("overwrite").parquet(f"{path}/survey/batch={batch}")


def cube_survey(spark: SparkSession, path: str, collections: Sequence[str] | None = None) -> DataFrame:
    """The survey of a written cube: its axes, granules and tiles without reading its cells."""
    stored = _stored(spark, path)
    if stored is None:
        raise ValueError(f"no cube at {path}")
    return stored if collections is None else stored.where(F.col("collection").isin(list(collections)))


def scan_cube(
    spark: SparkSession, path: str, box: Box | None = None, *,
    start: str | None = None, end: str | None = None, collections: Sequence[str] | None = None,
) -> DataFrame:
    """Cells of a written cube. Box, times and collections choose batches and tiles by the cube's survey.

    Of the survey, one row per batch is read, and one for each tile of a batch that the box touches. Only the folders of those
    batches are listed, and only those of the tiles are read, with a known schema.
    """
    first, last = (F.to_timestamp(F.lit(t)) for t in (start, end))
    during = F.lit(True) if start is None else F.col("ts_to") >= first
    during = during if end is None else during & (F.col("ts") < last)
    inside = F.lit(False)
    if box is not None:
        inside = (F.col("kind") == "tile") & (F.col("lon_hi") >= float(box[0])) & (F.col("lon_lo") <= float(box[2])) & (F.col("lat_hi") >= float(box[1])) & (F.col("lat_lo") <= float(box[3]))
        inside = inside if collections is None else inside & F.col("collection").isin(list(collections))
    rows = cube_survey(spark, path).where((F.col("kind") == "schema") | inside).select("batch", "kind", "tile_i", "tile_j", F.coalesce(during, F.lit(False)).alias("during"), "stored_schema").collect()
    batches = {r["batch"]: r for r in sorted(rows, key=lambda r: r["batch"]) if r["kind"] == "schema"}
    schema = joined_schema(*[T.StructType.fromJson(json.loads(x)) for x in dict.fromkeys(r["stored_schema"] for r in batches.values())])
    tiles = [r for r in rows if r["kind"] == "tile" and batches[r["batch"]]["during"]]
    wanted = [b for b, r in batches.items() if r["during"]] if box is None else sorted({r["batch"] for r in tiles})
    whole = T.StructType([*schema.fields, *[T.StructField(n, T.IntegerType()) for n in ("tile_i", "tile_j")]])
    if not wanted:
        return spark.createDataFrame([], schema)
    cells = spark.read.schema(whole).option("basePath", f"{path}/cells").parquet(*[f"{path}/cells/batch={b}" for b in wanted])
    for c in ("tile_i", "tile_j") if tiles else ():
        cells = cells.where(F.col(c).between(min(r[c] for r in tiles), max(r[c] for r in tiles)))
    if collections is not None:
        cells = cells.where(F.col("collection").isin(list(collections)))
    if start is not None:
        cells = cells.where(F.col("ts") >= first)
    if end is not None:
        cells = cells.where(F.col("ts") < last)
    if box is not None:
        cells = cells.where(in_box(box))
    return _missing_as_null(cells.select(schema.names))


def _missing_as_null(cells: DataFrame) -> DataFrame:
    """NaN in any data column becomes NULL; coordinates stay, so that filters on them reach the reader."""
    numbers = [c for c, kind in cells.dtypes if kind in ("float", "double") and c not in ("lat", "lon")]
    return cells.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})


def concat_granules(*parts: DataFrame) -> DataFrame:
    """Granule sets of one product, combined on time; a band one set lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def synthesize_time(granules: DataFrame) -> DataFrame:
    """Fill a missing `ts` from the beginning date and time attributes; a real time stays.

    Unreadable attributes leave it missing.
    """
    time = F.coalesce(F.rtrim(F.col("range_beginning_time"), F.lit("Z")), F.lit("00:00:00"))
    made = F.try_to_timestamp(F.concat(F.col("range_beginning_date"), F.lit("T"), time))
    return granules.withColumn("ts", F.coalesce(F.col("ts"), made.cast(granules.schema["ts"].dataType)))


def attrs_time_range(granules: DataFrame) -> DataFrame:
    """Coverage start and end from the attributes: the coverage pair, then the range pair with its time."""
    def found(first: str, date: str, time: str):
        d = F.nullif(F.trim(date), F.lit(""))
        t = F.nullif(F.trim(time), F.lit(""))
        dated = F.when(t.isNotNull() & (F.instr(d, "T") == 0), F.concat(d, F.lit("T"), F.rtrim(t, F.lit("Z")))).otherwise(d)
        return F.coalesce(F.nullif(F.trim(first), F.lit("")), dated, F.lit(""))

    return granules.withColumns({
        "coverage_start": found("time_coverage_start", "range_beginning_date", "range_beginning_time"),
        "coverage_end": found("time_coverage_end", "range_ending_date", "range_ending_time"),
    })


def first_granules(cells: DataFrame) -> DataFrame:
    """The granule kept per collection and timestamp, the first by name, and how many were dropped.

    `cells` may be the granules of a survey.
    """
    named = cells.select("collection", "ts", "granule_id").distinct()
    return named.groupBy("collection", "ts").agg(
        F.min("granule_id").alias("granule_id"), (F.count(F.lit(1)) - 1).alias("dropped")
    )


def dedup_time(cells: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Cells of the first granule per timestamp. Only granule names are compared, never cells.

    `named` holds the granules, from a survey; without it they are taken from the cells. The kept ones are written first,
    so that Spark knows their size and the cells need not be shuffled to meet them.
    """
    kept = settle(first_granules(cells if named is None else named), "granules").select(*[F.col(c).alias(f"_{c}") for c in ("collection", "ts", "granule_id")])
    # A missing time or name is a stamp like any other.
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("collection", "ts", "granule_id")]
    return cells.join(kept, same[0] & same[1] & same[2], "left_semi")


def duplicate_report(cells: DataFrame) -> DataFrame:
    """Granules kept and dropped per collection."""
    return first_granules(cells).groupBy("collection").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("dropped").alias("duplicates")
    )

"""Cells and samples as streams.

Every job is a plain streaming DataFrame; `run_to_files` writes one to a file sink with its own
checkpoint. Windows close when the watermark passes their end; rows older than the watermark are
dropped and counted. `run_bounded` also returns the windows that are still open when the input ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.functions.aggregates import weighted_mean
from cellwright.functions.scalars import nan_to_null, site_id
from cellwright.operators.reductions import qa_counters

# --- Fixed values ---------------------------------------------------------------------------------
GRANULES_PER_TRIGGER = 4
POLL_SECONDS = 1
# --------------------------------------------------------------------------------------------------


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = GRANULES_PER_TRIGGER, glob: str | None = None) -> DataFrame:
    """New Parquet files of a folder, a few per trigger, with a fixed schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Process what is there, append the result to `path`, and return the progress reports."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    reports: dict = {}
    done = False
    while not done:
        # a query remembers its latest reports only, so they are gathered while it runs
        done = query.awaitTermination(POLL_SECONDS)
        for p in query.recentProgress:
            p = p if isinstance(p, dict) else json.loads(p.json)
            reports[p["batchId"], p["timestamp"]] = p
    return [reports[k] for k in sorted(reports)]


def late_rows(progress: list[dict]) -> int:
    """Rows dropped by the watermark over the reported batches."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))


def reject_reason() -> Column:
    """Why a cell row cannot be stored, or NULL."""
    outside = ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 360), F.lit(False))
    return (
        F.when(F.col("granule_id").isNull() | F.col("collection").isNull(), "no granule")
        .when(F.col("ts").isNull(), "no time")
        .when(F.col("i").isNull() | F.col("j").isNull(), "no position")
        .when(outside, "no place")
    )


def _store(batch: DataFrame, path: str, number: int) -> None:
    """One batch: its cells, its rejected rows, and last its line in the manifest, by which it counts as stored.

    Each batch writes folders of its own number, so a batch that runs twice leaves one copy.
    """
    marked = batch.withColumn("reason", reject_reason()).persist()
    numbers = [c for c, kind in batch.dtypes if kind in ("float", "double") and c not in ("lat", "lon")]
    good = marked.where(F.col("reason").isNull()).drop("reason").withColumns({c: nan_to_null(c) for c in numbers})
    good.write.mode("overwrite").parquet(f"{path}/cells/batch={number}")
    marked.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
    counted = marked.agg(F.count_if(F.col("reason").isNull()).alias("cells"), F.count_if(F.col("reason").isNotNull()).alias("rejects"))
    counted.write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    marked.unpersist()


MANIFEST = "cells long, rejects long, batch long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored batches: one row for each, with its numbers of cells and of rejected rows."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def ingested(spark: SparkSession, path: str, kind: str = "cells") -> DataFrame:
    """Stored `cells` or `rejects` of the batches in the manifest. What a batch left behind that did not end is not read."""
    numbers = sorted(r["batch"] for r in manifest(spark, path).select("batch").collect())  # one number per batch
    schema = contract(spark, path)
    schema = schema if kind == "cells" or schema is None else T.StructType([*schema.fields, T.StructField("reason", T.StringType())])
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return reader.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={n}" for n in numbers])


def contract(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema that every file of an ingest must have, kept beside the stored cells; None before the first batch."""
    try:
        kept = spark.read.text(f"{path}/contract").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return T.StructType.fromJson(json.loads(kept["value"]))


def breaches(schema: T.StructType, agreed: T.StructType) -> list[str]:
    """How the schema of a file departs from the agreed one: columns that it lacks, adds, or holds with another type."""
    own, due = ({f.name: f.dataType.simpleString() for f in x} for x in (schema, agreed))
    return ([f"{c} is missing" for c in due if c not in own] + [f"{c} is not agreed on" for c in own if c not in due]
            + [f"{c} is {own[c]}, not {due[c]}" for c in due if c in own and own[c] != due[c]])


def stream_ingest_files(spark: SparkSession, folder: str, path: str, checkpoint: str, per_trigger: int = GRANULES_PER_TRIGGER) -> None:
    """Append the granule files that arrive in a folder, a few per batch, all of one schema.

    The first file by name of the first batch sets the schema. Every file's own schema is checked before any row of its batch is
    read or stored; a batch with a file that departs from it fails as a whole, with all departures named, and stays
    to be done: after the file is mended or taken away, the next run goes on with that batch.
    """
    def take(batch: DataFrame, number: int) -> None:
        names = sorted(r["file_path"] for r in batch.select("file_path").distinct().collect())  # at most per_trigger names
        if not names:
            return
        schemas = {n: spark.read.parquet(n).schema for n in names}
        agreed = contract(spark, path)
        due = schemas[names[0]] if agreed is None else agreed
        wrong = {n: found for n, x in schemas.items() if (found := breaches(x, due))}
        if wrong:
            raise ValueError("; ".join(f"{n.rsplit('/', 1)[-1]}: {', '.join(x)}" for n, x in wrong.items()))
        if agreed is None:
            spark.createDataFrame([(due.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
        _store(spark.read.schema(due).parquet(*names), path, number)

    arriving = read_stream(spark, folder, T.StructType([T.StructField("granule_id", T.StringType())]), per_trigger)
    query = arriving.select("_metadata.file_path").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_ingest_cells(cells: DataFrame, path: str, checkpoint: str) -> None:
    """Append arriving cells under `path/cells`, bad rows with their reason under `path/rejects`, each batch once."""
    query = cells.writeStream.foreachBatch(lambda batch, number: _store(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_dedup_granules(cells: DataFrame, delay: str = "1 day", keys: Sequence[str] = ("collection", "ts", "i", "j")) -> DataFrame:
    """Per key the row of the first granule by name, whatever the order of arrival; a missing name comes last.

    A key's row is emitted once the watermark has passed its time, and its state ends there.
    """
    rest = [c for c in cells.columns if c not in keys]
    ranked = F.min(F.struct(F.col("granule_id").isNull().alias("_unnamed"), F.col("granule_id").alias("_name"), *rest))
    first = cells.withWatermark("ts", delay).groupBy(*keys).agg(ranked.alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in cells.columns])


def _windowed(cells: DataFrame, delay: str, width: str, *keys: str):
    return cells.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys)


def stream_timeseries(cells: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Area-weighted regional mean of masked cells per window; windows without a value are left out."""
    out = _windowed(cells, delay, width).agg(weighted_mean("value").alias("value"), F.count("value").alias("n"))
    return out.where(F.col("value").isNotNull()).select(F.col("w.start").alias("ts"), "value", "n")


def stream_qa_pass_rate(cells: DataFrame, width: str = "1 day", delay: str = "2 hours", good=None, bad=None) -> DataFrame:
    """Checked, passing and flag-missing counts and the area-weighted pass rate per window."""
    out = _windowed(cells, delay, width).agg(*[c.alias(n) for n, c in qa_counters(good, bad).items()])
    return out.select(F.col("w.start").alias("ts"), "checked", "passing", "flag_missing", "pass_rate")


def stream_exceedance(samples: DataFrame, hard: float, delay: str = "2 hours") -> DataFrame:
    """Site days whose highest sample is over the limit, emitted once the day is complete."""
    rows = samples.withColumn("site_id", site_id())
    out = _windowed(rows, delay, "1 day", "site_id").agg(F.max("sample_measurement").alias("value"))
    return out.where(F.col("value") > hard).select("site_id", F.col("w.start").alias("day"), "value")


def run_bounded(
    job: Callable[[DataFrame], DataFrame], arriving: DataFrame, arrived: DataFrame, path: str, checkpoint: str, start: str = "ts", width: str = "0 seconds"
) -> DataFrame:
    """Run a job over all that has arrived and return every window, open ones included.

    Closed windows are what the stream wrote to `path`. None of an open window's rows can have been late, so open windows are
    the same job in batch over `arrived`, the rows of the same source, from the time on at which they can begin. They are not
    written: a later run on the same checkpoint goes on with them. `start` names the result's window start.
    """
    spark = arrived.sparkSession
    stream = job(arriving)
    marks = [p["eventTime"]["watermark"] for p in run_to_files(stream, path, checkpoint) if "watermark" in p.get("eventTime", {})]
    if not marks:
        raise ValueError("the run reported no watermark")
    mark = F.lit(max(marks)).cast("timestamp")
    span = F.expr(f"INTERVAL {width}")
    still_open = job(arrived.where(F.col("ts") > mark - span)).where(F.col(start) + span > mark)
    return spark.read.schema(stream.schema).parquet(path).unionByName(still_open)

"""Access to the given tables and small helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def scan_tasks(df: DataFrame) -> int:
    """How many tasks read the frame; follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    found = batch.column(batch.schema.get_field_index(name))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found

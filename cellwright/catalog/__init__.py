"""The registered queries with their reference SQL, one module per family."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _in_utc(query: Query) -> Query:
    """Times are UTC throughout; a session in another zone would read dates differently."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def registry() -> dict[str, tuple[Query, str | None]]:
    """Every query by name with its reference SQL."""
    from cellwright.catalog import (
        comparison, ground, inventory, masking, records, reductions, regions, sources, sql, streaming,
    )

    found: dict[str, tuple[Query, str | None]] = {}
    for family in (sources, masking, regions, reductions, comparison, ground, inventory, records, streaming, sql):
        for name, (query, sql) in family.QUERIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = (_in_utc(query), sql)
    return found

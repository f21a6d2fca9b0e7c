"""Registered queries: the streaming jobs, run over the given events until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.catalog._common import as_text, r6
from cellwright.catalog.fixtures import fixture
from cellwright.operators import masking as M
from cellwright.session import fresh_path
from cellwright.streaming import jobs as J

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
])


def _events(s, d):
    return J.read_stream(s, d, EVENTS, glob="events.parquet")


def _arrived(s, d):
    return s.read.schema(EVENTS).parquet(f"{d}/events.parquet")


def _cells(e, granule=None):
    """Every event as one observed cell; some lack a time, a position or a place."""
    n = F.col("event_id") % 50
    return e.select(
        F.lit("STREAM").alias("collection"), (F.concat(F.lit("g"), F.date_format("ts", "yyyyMMddHH")) if granule is None else granule).alias("granule_id"),
        F.when(n != 1, F.col("ts")).alias("ts"), F.when(n != 2, F.col("user_id") % 30).cast("int").alias("i"), (F.col("user_id") % 20).cast("int").alias("j"),
        F.when(n == 3, 95.0).otherwise((25 + F.col("user_id") % 30).cast("double")).alias("lat"), (-110 + 1.5 * (F.col("user_id") % 20)).cast("double").alias("lon"),
        "value", (F.col("event_id") % 3).cast("int").alias("qa_flag"),
    )


def _masked(e):
    e = e.select("ts", (25 + F.col("user_id") % 30).cast("double").alias("lat"), F.col("value").alias("raw_value"), (F.col("event_id") % 3).cast("int").alias("qa_flag"))
    return M.mask_cells(e, vmin=2.0, vmax=300.0, good=[0])


def _ingest(s, d):
    path = fresh_path(s, "ingest")
    J.stream_ingest_cells(_cells(_events(s, d)), path, f"{path}/checkpoint")
    good = s.read.parquet(f"{path}/cells").select(F.lit("stored").alias("reason"))
    bad = s.read.parquet(f"{path}/rejects").select("reason")
    return good.unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


def _ingest_files(s, d):
    """The events as three granule files, taken one per batch; the second run finds nothing new."""
    path = fresh_path(s, "files")
    for n in range(3):
        _cells(_arrived(s, d).where(F.col("event_id") % 3 == n)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for _ in range(2):
        J.stream_ingest_files(s, f"{path}/in", f"{path}/out", f"{path}/checkpoint", 1)
    batches = J.manifest(s, f"{path}/out").agg(F.count("*")).scalar()
    good = J.ingested(s, f"{path}/out").select("granule_id", F.lit("stored").alias("reason"), "value")
    bad = J.ingested(s, f"{path}/out", "rejects").select("granule_id", "reason", "value")
    return good.unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"), F.count("granule_id").alias("named"), F.round(F.max("value"), 6).alias("top")).withColumn("batches", batches)


def _run(s, d, job, start="ts", width="0 seconds"):
    path = fresh_path(s, "stream")
    return as_text(J.run_bounded(job, _events(s, d), _arrived(s, d), f"{path}/out", f"{path}/checkpoint", start, width), start)


def _dedup(s, d):
    def job(e):
        cells = _cells(e.withColumn("ts", F.date_trunc("hour", "ts")), F.format_string("g%012d", "event_id"))
        return J.stream_dedup_granules(cells.where("ts IS NOT NULL AND i IS NOT NULL"))

    return _run(s, d, job).select("ts", "i", "j", "granule_id", "value")


def _exceedance(s, d):
    m = fixture(s, d, "fx_monitors").select("state_code", "county_code", "site_number", "site_key")

    def job(e):
        samples = e.select("ts", (F.col("user_id") % 100).alias("site_key"), F.col("value").alias("sample_measurement"))
        return J.stream_exceedance(samples.join(m, "site_key"), 150.0)

    return _run(s, d, job, "day", "1 day")


_W = "greatest(cos(radians(lat)), 0)"
_C = """SELECT ts, CAST(25 + user_id % 30 AS DOUBLE) AS lat, CASE WHEN value BETWEEN 2 AND 300 THEN value END AS checked, event_id % 3 AS qa_flag FROM events"""

QUERIES = {
    "stream_ingest_cells": (
        _ingest,
        """SELECT CASE event_id % 50 WHEN 1 THEN 'no time' WHEN 2 THEN 'no position' WHEN 3 THEN 'no place' ELSE 'stored' END AS reason, count(*) AS n FROM events GROUP BY 1""",
    ),
    "stream_ingest_files": (
        _ingest_files,
        """SELECT CASE event_id % 50 WHEN 1 THEN 'no time' WHEN 2 THEN 'no position' WHEN 3 THEN 'no place' ELSE 'stored' END AS reason, count(*) AS n,
        count(*) AS named, round(max(value), 6) AS top, CAST(3 AS BIGINT) AS batches FROM events GROUP BY 1""",
    ),
    "stream_dedup_granules": (
        _dedup,
        """SELECT CAST(h AS VARCHAR) AS ts, i, j, printf('g%012d', id) AS granule_id, value FROM (SELECT date_trunc('hour', ts) AS h, CAST(user_id % 30 AS INT) AS i, CAST(user_id % 20 AS INT) AS j,
        min(event_id) AS id, arg_min(value, event_id) AS value FROM events WHERE event_id % 50 NOT IN (1, 2) GROUP BY ALL)""",
    ),
    "stream_timeseries": (
        lambda s, d: r6(_run(s, d, lambda e: J.stream_timeseries(_masked(e)), width="1 hour"), "value"),
        f"""WITH c AS ({_C}) SELECT CAST(date_trunc('hour', c.ts) AS VARCHAR) AS ts, round(sum(checked * {_W}) / sum({_W}), 6) AS value, count(*) AS n FROM c WHERE qa_flag = 0 AND checked IS NOT NULL
        GROUP BY date_trunc('hour', c.ts)""",
    ),
    "stream_qa_pass_rate": (
        lambda s, d: _run(s, d, lambda e: J.stream_qa_pass_rate(_masked(e), good=[0]), width="1 day"),
        f"""WITH c AS ({_C}) SELECT CAST(CAST(date_trunc('day', c.ts) AS TIMESTAMP) AS VARCHAR) AS ts, count(checked) AS checked, count(checked) FILTER (qa_flag = 0) AS passing, CAST(0 AS BIGINT) AS flag_missing,
        round(sum({_W}) FILTER (qa_flag = 0 AND checked IS NOT NULL) / sum({_W}) FILTER (checked IS NOT NULL), 6) AS pass_rate FROM c GROUP BY date_trunc('day', c.ts)""",
    ),
    "stream_exceedance": (
        _exceedance,
        """SELECT concat_ws('-', lpad(CAST(s_nationkey AS VARCHAR), 2, '0'), lpad(CAST(s_suppkey % 7 AS VARCHAR), 3, '0'), lpad(CAST(s_suppkey AS VARCHAR), 4, '0')) AS site_id, CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS day, max(value) AS value
        FROM events JOIN supplier ON user_id % 100 = s_suppkey GROUP BY s_nationkey, s_suppkey, date_trunc('day', ts) HAVING max(value) > 150""",
    ),
}

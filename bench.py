"""Headline queries on one machine, and the region crop of the baseline's grid, written as a cube.

Prints one JSON line. Times are medians of warm runs that compute every row of the result.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from cellwright.catalog import registry
from cellwright.operators.reductions import field_statistics
from cellwright.session import build_session, fresh_path
from cellwright.sources.cells import scan_cube, write_cube

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
CROP_RUNS = 5
CROP_BOX = (-74.9, 39.1, -73.1, 40.9)

HEADLINE = [
    "mask_cells", "crop_bounds", "region_mask_polygon", "normalize_longitude", "dedup_time",
    "temporal_mean", "regional_statistics", "find_peak", "regional_timeseries", "qa_pass_rate", "evidence_facts",
    "heatmap", "heatmap_multi", "region_comparison", "anomaly_stats", "percentile_bounds", "sample_points",
    "ground_summary_daily", "ground_summary_quarterly", "exceedance_days", "exceedance_dates", "nearest_monitors",
    "monitor_series", "validate_against_ground", "exceedance_overlay",
    "classify_variables", "resolve_variable", "merge_lineage", "route_messages", "merge_turns",
    "export_wide_csv", "stream_timeseries",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def stages(spark) -> dict[int, int]:
    """Input bytes of the stages that the session still remembers, by stage id."""
    sc = spark.sparkContext
    no_quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, sc._jvm.java.util.ArrayList())
    return {found.apply(k).stageId(): found.apply(k).inputBytes() for k in range(found.size())}


def published_grid(spark):
    """The grid of the baseline: 4 hourly granules of 1750 x 3250 float32 cells."""
    rows, columns = 1750, 3250
    place = F.col("id") % (rows * columns)
    i, j = F.floor(place / columns).cast("int"), (place % columns).cast("int")
    hour = F.floor(F.col("id") / (rows * columns)).cast("int")
    return spark.range(4 * rows * columns).select(
        F.lit("GRID").alias("collection"), F.concat(F.lit("g"), hour.cast("string")).alias("granule_id"), F.timestamp_seconds(F.lit(1704067200) + hour * 3600).alias("ts"),
        i.alias("i"), j.alias("j"), (20 + i * (35.0 / (rows - 1))).alias("lat"), (-130 + j * (65.0 / (columns - 1))).alias("lon"),
        (F.rand(7) * 5e-6).cast("float").alias("value"))


def crop(spark) -> dict:
    """Bytes and time of a regional statistic against the same statistic of the whole cube."""
    path = fresh_path(spark, "bench-cube")
    out = {"write_sec": round(timed(lambda: write_cube(published_grid(spark), path)), 1)}
    for label, box in (("whole", None), ("box", CROP_BOX)):
        times = []
        for _ in range(CROP_RUNS + 1):
            before = max(stages(spark), default=-1)
            times.append(timed(lambda: field_statistics(scan_cube(spark, path, box)).collect()))
            out[f"{label}_bytes"] = sum(size for k, size in stages(spark).items() if k > before)
        out[f"{label}_sec"] = round(statistics.median(times[1:]), 3)
    out["speedup"] = round(out["whole_sec"] / out["box_sec"], 2)
    return out


def main() -> None:
    # without vectored reads Spark counts all bytes that Parquet reads
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=int(CPUS), spark__hadoop__parquet__hadoop__vectored__io__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    queries = registry()
    seconds = {}
    for name in queries if os.environ.get("BENCH_ALL") else HEADLINE:
        query = queries[name][0]
        run = lambda query=query: query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "crop": crop(spark),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

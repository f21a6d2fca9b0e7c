"""Lineage, audits, logs and conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import date_part, place_key
from cellwright.operators import order_stats

# --- Fixed values ---------------------------------------------------------------------------------
HANDLE_KINDS = {
    "dataset": "dataset",
    "aoi": "aoi",
    "obs": "observation",
    "cube": "cube",
    "job": "job",
    "query": "query",
    "preview": "preview",
}
PHASES = ["export", "extract", "open", "crop", "mask", "aggregate", "render", "qa_pass_rate"]
SOFT_CAP_BYTES, HARD_CAP_BYTES = 2 * 1024**3, 10 * 1024**3
GROUND_PATTERNS = [
    r"\b(nearest|closest|find|locate|where\s+is)\b.{0,20}\b(monitor|sensor|station|site)\b",
    r"\b(site|station)\s+(info|details?|information)\b",
    r"\b(daily|quarterly|annual)\s+(reading|summary|data|report|average)\b",
    r"\bexceedance(s)?\b",
    r"\bhourly\s+(profile|reading|data)\b",
    r"\bair\s+quality\s+(data|reading|levels?|index|report)\b",
    r"\bAQI\b",
    r"\b(EPA|AQS)\s+(monitor|data|station|sensor)\b",
    r"\b(NO2|PM2\.5|PM25|ozone|SO2|CO)\s+(monitor|sensor|station|site|reading|level)\b",
]
SATELLITE_PATTERNS = [
    r"\b(TROPOMI|OMI|TEMPO|MODIS)\b",
    r"\bsatellite\s+(map|plot|data|image|reading|measurement)\b",
    r"\b(plot|map|visualize|visualise|display|render)\b.{0,40}\b(NO2|ozone|aerosol|CO|SO2|HCHO|formaldehyde)\b",
    r"\b(gridded|column\s+density|spatial\s+pattern|spatial\s+distribution)\b",
    r"\b(Harmony|NASA\s+data|satellite\s+granule)\b",
]
CROSS_PATTERNS = [
    r"\b(compare|comparison|versus|vs\.?)\b.{0,60}\b(ground|satellite|TROPOMI|EPA)\b",
    r"\b(ground|EPA).{0,60}\b(satellite|TROPOMI|OMI|TEMPO)\b",
    r"\bconfirm\b.{0,40}\b(ground|exceedance)\b.{0,40}\b(satellite|space)\b",
]
# --------------------------------------------------------------------------------------------------


# --- Lineage --------------------------------------------------------------------------------------

def handle_kind(handle: Column | str) -> Column:
    """Kind of a node from its handle's prefix; `step` when the prefix is unknown."""
    prefix = F.substring_index(handle, "_", 1)
    kind = F.lit("step")
    for p, k in HANDLE_KINDS.items():
        kind = F.when(prefix == p, k).otherwise(kind)
    return kind


def merge_lineage(walks: DataFrame) -> DataFrame:
    """One lineage from many walks: ancestors before targets, each handle once, the first one kept.

    `walks` holds (walk_no, handle, resolved_handle, ancestors array<struct<handle, depth>>,
    events array, newest first). `seen_at` orders the nodes.
    """
    ancestors = walks.select("walk_no", F.posexplode("ancestors").alias("pos", "a")).select(
        F.col("a.handle").alias("handle"),
        F.struct(
            F.col("walk_no").cast("long").alias("walk_no"), F.lit(0).alias("part"),
            (-F.coalesce("a.depth", F.lit(0))).cast("long").alias("place"), F.col("pos").alias("pos"),
        ).alias("seen_at"),
        F.col("a.depth").cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("events"),
    ).where(F.col("handle").isNotNull())
    targets = walks.select(
        F.coalesce("resolved_handle", "handle").alias("handle"),
        F.struct(F.col("walk_no").cast("long").alias("walk_no"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("pos")).alias("seen_at"),
        F.lit(None).cast("int").alias("depth"), F.reverse("events").alias("events"),
    )
    first = ancestors.unionByName(targets).groupBy("handle").agg(
        F.min("seen_at").alias("seen_at"), F.min_by(F.struct("depth", "events"), "seen_at").alias("n")
    )
    return first.select("handle", handle_kind("handle").alias("kind"), F.col("n.depth").alias("depth"), F.col("n.events").alias("events"), "seen_at")


def distinct_citations(lineage: DataFrame, citations: DataFrame) -> DataFrame:
    """Citation of every distinct dataset in a lineage."""
    return lineage.where(F.col("kind") == "dataset").select("handle").distinct().join(citations, "handle")


def scope_audit(results: DataFrame) -> DataFrame:
    """What was delivered other than asked, as facts and as one note; NULL when nothing differs.

    Reads `time_range` (start/end), `location`, `start_date`, `end_date`, `region_name`, `cadence`.
    """
    asked_from = date_part(F.substring_index("time_range", "/", 1))
    asked_to = F.when(F.instr("time_range", "/") > 0, date_part(F.regexp_replace("time_range", "^[^/]*/", ""))).otherwise(asked_from)
    rows = results.withColumns({"_af": asked_from, "_at": asked_to, "_df": date_part("start_date"), "_dt": date_part("end_date")})
    span = lambda a, b: F.when(F.col(a).eqNullSafe(F.col(b)), F.col(a)).otherwise(F.concat(F.col(a), F.lit(" to "), F.col(b)))
    time_differs = (
        F.col("_af").isNotNull() & F.col("_df").isNotNull()
        & ~(F.col("_af").eqNullSafe(F.col("_df")) & F.col("_at").eqNullSafe(F.col("_dt")))
    )
    loc, reg = F.trim(F.coalesce("location", F.lit(""))), F.trim(F.coalesce("region_name", F.lit("")))
    place_differs = (loc != "") & (reg != "") & (place_key(loc) != place_key(reg))
    cadence = F.trim(F.coalesce("cadence", F.lit("")))
    kind = F.when((cadence != "") & (F.lower(cadence) != "unknown"), F.concat(F.lit(", from "), cadence, F.lit(" data"))).otherwise("")
    unlike = lambda asked, given: F.concat(asked, F.lit(" was wanted, "), given, F.lit(" is given"))
    clauses = F.array_compact(F.array(
        F.when(time_differs, F.concat(unlike(span("_af", "_at"), span("_df", "_dt")), kind)), F.when(place_differs, unlike(loc, reg))))
    return rows.withColumns({
        "time_differs": time_differs, "place_differs": place_differs, "note": F.when(F.size(clauses) > 0, F.array_join(clauses, "; ")),
    }).drop("_af", "_at", "_df", "_dt")


# --- Retrieval gates and logs ---------------------------------------------------------------------

def granule_totals(granules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and size of all granules of each group, and how many of them state no size."""
    return granules.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.coalesce("size_mb", F.lit(0.0))).alias("total_size_mb"),
        F.count_if(F.col("size_mb").isNull()).alias("unsized"),
    )


def granule_listing(granules: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """The first `limit` granules of each group, with their rank; every task keeps only its own first ones."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return granules.withColumn("rank", rank).where(F.col("rank") <= limit)


def size_gate(estimates: DataFrame, keys: Sequence[str], soft: int = SOFT_CAP_BYTES, hard: int = HARD_CAP_BYTES) -> DataFrame:
    """Whether a retrieval may run: refused over the hard cap; over the soft cap or unpriced it asks first."""
    total = estimates.groupBy(*keys).agg(F.sum("bytes").alias("estimated_bytes"), F.bool_or("confirmed").alias("_ok"))
    b, ok = F.col("estimated_bytes"), F.coalesce("_ok", F.lit(False))
    status = (
        F.when(b > hard, "refused").when((b.isNull() | (b > soft)) & ~ok, "needs_confirmation").otherwise("submitted")
    )
    return total.withColumn("status", status).drop("_ok")


def phase_rollup(log: DataFrame) -> DataFrame:
    """Count, total and exact quantiles of the durations of each phase; known phases always appear."""
    known = log.sparkSession.createDataFrame([(p,) for p in PHASES], "phase string")
    sums = log.groupBy("phase").agg(F.count("duration_seconds").alias("count"), F.sum("duration_seconds").alias("total_seconds"))
    spread = order_stats.quantiles(log, ["phase"], "duration_seconds", {"p50": 0.5, "p95": 0.95}).drop("n")
    return known.join(sums, "phase", "full").join(spread, "phase", "left").na.fill({"count": 0, "total_seconds": 0.0})


# --- Conversations --------------------------------------------------------------------------------

def _any_pattern(text: Column, patterns: list[str]) -> Column:
    """Case-insensitive, dot matches newlines, word boundaries by Unicode letters."""
    return text.rlike("(?isU)" + "|".join(patterns))


def route_label(text: Column | str) -> Column:
    """GROUND, SATELLITE, BOTH or LLM, from the whole text of a message."""
    text = F.col(text) if isinstance(text, str) else text
    ground, satellite = _any_pattern(text, GROUND_PATTERNS), _any_pattern(text, SATELLITE_PATTERNS)
    return (
        F.when(_any_pattern(text, CROSS_PATTERNS) | (ground & satellite), "BOTH")
        .when(ground, "GROUND").when(satellite, "SATELLITE").otherwise("LLM")
    )


def route_messages(messages: DataFrame) -> DataFrame:
    return messages.select(route_label("text").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def merge_turns(turns: DataFrame, chunk: int = 4096) -> DataFrame:
    """Conversations with runs of assistant messages merged into one, texts joined by blank lines.

    Turns are windowed in chunks of the turn number, so a conversation of any length is never one
    task: a chunk finds its runs alone, and a run that reaches a chunk's first turn is tied to the
    run that ends the chunk before it.
    """
    rows = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / chunk).alias("_chunk"))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("turn")
    before = F.lag("role").over(inside)
    begins = ~((F.col("role") == "assistant") & F.coalesce(before == "assistant", F.lit(False)))
    local = rows.withColumn("_run", F.sum(begins.cast("int")).over(inside))
    # One row per chunk: its edges and how many runs it holds.
    edges = local.groupBy("conv_id", "_chunk").agg(
        F.min_by("role", "turn").alias("_first"), F.max_by("role", "turn").alias("_last"), F.max("_run").alias("_runs")
    )
    along = Window.partitionBy("conv_id").orderBy("_chunk")
    tied = (F.col("_first") == "assistant") & F.coalesce(F.lag("_last").over(along) == "assistant", F.lit(False))
    edges = edges.withColumn("_tied", tied.cast("int"))
    # A tied chunk's first run is the last run of the chunk before it.
    offset = F.sum(F.col("_runs") - F.col("_tied")).over(along) - F.col("_runs")
    edges = edges.select("conv_id", "_chunk", offset.alias("_offset"))
    numbered = local.join(edges, ["conv_id", "_chunk"]).withColumn("message", (F.col("_run") + F.col("_offset")).cast("long"))
    parts = F.array_sort(F.array_agg(F.struct("turn", "text")))
    return numbered.groupBy("conv_id", "message", "role").agg(
        F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("merged"),
        F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("text"),
    )

"""Variable inventories: axes, roles, and which variable a file is about.

An inventory row is one variable of one file (`file_id`, `ordinal`, `name`, attributes). Everything
here is a row expression or one grouped aggregation per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import (
    contains_any, coverage_decile, ends_with_any, group_of, leaf, normalized,
)
from cellwright.operators import order_stats

# --- Fixed values: vocabularies of the role rules -------------------------------------------------
QUALITY_GROUPS = ["qa_statistics"]
GEOMETRY_GROUPS = ["geolocation"]
SCIENCE_GROUPS = ["product", "key_science_data"]
COORDINATE_STANDARD_NAMES = [
    "latitude", "longitude", "time",
    "projection_x_coordinate", "projection_y_coordinate",
]
SCIENCE_STANDARD_NAMES = [
    "mole_content", "mole_fraction", "optical_depth", "optical_thickness",
    "column_number_density", "column_density", "number_density_of",
    "mass_content_of", "mixing_ratio",
]
QUALITY_STANDARD_NAMES = ["quality_flag", "status_flag", "standard_error", "number_of_observations"]
COORDINATE_NAMES = ["latitude", "longitude", "lat", "lon", "time", "xdim", "ydim", "x", "y"]
QUALITY_SUFFIXES = ["uncertainty", "qualityflag", "flag", "precision", "std", "stddev", "error"]
UNCERTAINTY_SUFFIXES = ["uncertainty", "precision", "stddev", "std", "error"]
QUALITY_PARTS = [
    "uncertainty", "qualityflag", "precision",
    "numberofpixel", "numberofsample", "numsample", "numberofobs",
]
GEOMETRY_PARTS = ["zenithangle", "azimuth"]
RETRIEVAL_PREFIX = "amf"
RETRIEVAL_PARTS = ["slantcolumn", "belowcloud", "ghost"]
CONTEXT_PARTS = [
    "cloudfraction", "cloudfrac", "cloudpressure", "cloudtop", "cloudheight",
    "cloudalbedo", "pressure", "albedo", "reflectivity", "terrain",
    "aerosolindex", "aerosol", "pbl", "snowice", "temperature",
]
SCIENCE_STEMS = [
    "verticalcolumn", "columnamount", "columndensity", "columnnumberdensity",
    "molecontent", "molefraction", "opticaldepth", "opticalthickness",
]
SCIENCE_TOKENS = ["aod"]
ROLES = ["science", "quality", "context", "retrieval-metadata", "unclassified"]

# Choice of the variable a file is about
PLUMBING_LEAVES = ["Standard_Deviation", "Pixel_Counts", "Histogram_Counts"]
PLUMBING_PATTERNS = [
    r"zenith_angle",
    r"azimuth_angle",
    r"scattering_angle",
    r"reflectance",
    r"land_ocean_mask",
    r"(^|[/_])mask($|[/_])",
    r"(^|[/_])ndvi($|[/_])",
    r"cloud_fraction",
    r"quality_flag",
    r"data_quality",
]
SCORE_MEAN = 100
SCORE_UNITS = 80
SCORE_GEOPHYSICAL = 40
SCORE_STANDARD_NAME = 30
SCORE_LONG_NAME = 20
SCORE_PLUMBING = -60
GEOPHYSICAL_ROOTS = [
    "aod", "aerosol", "optical_depth", "angstrom",
    "no2", "o3", "ozone", "so2", "hcho", "formaldehyde", "ch4", "methane",
    "carbon_monoxide", "column", "concentration", "mixing_ratio",
    "temperature", "precipitation", "radiance", "brightness",
]
SENSOR_RANK = {"terra": 0, "aqua": 1, "snpp": 2, "noaa20": 3, "noaa-20": 3, "viirs": 4}
ALGORITHM_RANK = {"darktarget": 0, "dark_target": 0, "deepblue": 1, "deep_blue": 1}
UNRANKED = 99

# Identification of axes
LAT_NAMES = ["lat", "latitude", "Latitude", "LAT"]
LON_NAMES = ["lon", "longitude", "Longitude", "LON", "long"]
TIME_NAMES = ["time", "Time", "TIME", "t"]
LAT_UNITS = ["degrees_north", "degree_north", "degrees_N", "degree_N", "degreesN", "degreeN"]
LON_UNITS = ["degrees_east", "degree_east", "degrees_E", "degree_E", "degreesE", "degreeE"]
BOUNDS_SUFFIXES = ["_bnds", "_bounds", "_vertices", "_edges"]
# --------------------------------------------------------------------------------------------------


def merge_group_variables(inventory: DataFrame) -> DataFrame:
    """Names after merging groups: the bare leaf, or the qualified name when several groups hold it.

    `name` is group-qualified; root variables have no group and keep their bare name. A group's
    variable whose merged name a root variable already has is `shadowed` by it.
    """
    same = Window.partitionBy("file_id", leaf("name"))
    grouped = F.instr("name", "/") > 0
    marked = inventory.withColumns({"_n": F.count_if(grouped).over(same), "_root": F.bool_or(~grouped).over(same)})
    keeps = grouped & (F.col("_n") > 1)
    return marked.withColumns({
        "merged_name": F.when(keeps, F.col("name")).otherwise(leaf("name")),
        "shadowed": grouped & ~keeps & F.col("_root"),
    }).drop("_n", "_root")


def _axis_choice(kind: str) -> Column:
    """Sort key of a candidate for an axis, NULL when it is none. Smallest wins."""
    if kind == "time":
        meta = (
            F.coalesce(F.trim("standard_name") == "time", F.lit(False))
            | F.coalesce(F.upper(F.trim("axis")) == "T", F.lit(False))
            | F.coalesce(F.col("dtype").startswith("datetime"), F.lit(False))
        )
        names = TIME_NAMES
        by_meta = F.struct(
            F.lit(0).alias("tier"), F.lit(0).alias("kind"), F.lit(0).alias("a"),
            F.when(F.col("is_dim"), 0).otherwise(1).alias("b"), F.col("ordinal").alias("c"), "name",
        )
        tier = F.lit(0)
    else:
        standard, units, names = ("latitude", LAT_UNITS, LAT_NAMES) if kind == "lat" else ("longitude", LON_UNITS, LON_NAMES)
        meta = F.coalesce(F.trim("standard_name") == standard, F.lit(False)) | F.coalesce(F.trim("units").isin(units), F.lit(False))
        tier = F.when(F.coalesce("is_ref", F.lit(False)), 0).otherwise(1)
        by_meta = F.struct(
            tier.alias("tier"), F.when(ends_with_any(F.col("name"), BOUNDS_SUFFIXES), 1).otherwise(0).alias("kind"),
            F.col("n_dims").alias("a"), F.when(F.col("is_dim"), 0).otherwise(1).alias("b"), F.col("ordinal").alias("c"), "name",
        )
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int")
    by_name = F.struct(
        tier.alias("tier"), F.lit(2).alias("kind"), place.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "name"
    )
    return F.when(meta, by_meta).when(place > 0, by_name)


def identify_axes(inventory: DataFrame) -> DataFrame:
    """Latitude, longitude and time variable of each file.

    The science variable's own coordinate references come first, then attributes (no bounds
    variables, fewest dimensions, dimension coordinates, file order), then known names.
    """
    return inventory.groupBy("file_id").agg(*[F.min(_axis_choice(k)).alias(k) for k in ("lat", "lon", "time")]).select(
        "file_id", F.col("lat.name").alias("lat_var"), F.col("lon.name").alias("lon_var"), F.col("time.name").alias("time_var")
    )


# --- Roles ----------------------------------------------------------------------------------------

def classify_variables(inventory: DataFrame) -> DataFrame:
    """Role and confidence of each variable by ordered evidence; the registry's own names override.

    Optional columns: `group_path`, `primary_var`, `quality_flag_var`.
    """
    has = set(inventory.columns)
    bare = leaf("name")
    n = normalized(bare)
    sn = F.lower(F.trim(F.coalesce("standard_name", F.lit(""))))
    path = F.when(F.instr("name", "/") > 0, F.slice(F.split("name", "/"), F.lit(1), F.size(F.split("name", "/")) - 1))
    path = F.coalesce(path, F.array().cast("array<string>"))
    extra = F.split("group_path", "/") if "group_path" in has else F.lit(None).cast("array<string>")
    groups = F.transform(F.concat(path, F.coalesce(extra, F.array().cast("array<string>"))), F.lower)
    in_group = lambda wanted: F.arrays_overlap(groups, F.array(*[F.lit(w) for w in wanted]))
    out = lambda role, confidence: F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))
    verdict = (
        F.when(sn.isin(COORDINATE_STANDARD_NAMES), out("context", "high"))
        .when(contains_any(sn, QUALITY_STANDARD_NAMES), out("quality", "high"))
        .when(contains_any(sn, SCIENCE_STANDARD_NAMES), out("science", "high"))
        .when(in_group(QUALITY_GROUPS), out("quality", "high"))
        .when(in_group(GEOMETRY_GROUPS), out("context", "high"))
        .when(n.isin(COORDINATE_NAMES), out("context", "high"))
        .when(contains_any(n, QUALITY_PARTS) | ends_with_any(n, QUALITY_SUFFIXES), out("quality", "medium"))
        .when(contains_any(n, GEOMETRY_PARTS), out("context", "medium"))
        .when(F.startswith(n, F.lit(RETRIEVAL_PREFIX)) | contains_any(n, RETRIEVAL_PARTS), out("retrieval-metadata", "medium"))
        .when(contains_any(n, CONTEXT_PARTS), out("context", "medium"))
        .when(in_group(SCIENCE_GROUPS), out("science", "high"))
        .when(contains_any(n, SCIENCE_STEMS + SCIENCE_TOKENS), out("science", "low"))
        .otherwise(F.struct(F.lit("unclassified").alias("role"), F.lit(None).cast("string").alias("confidence")))
    )
    for column, role in (("quality_flag_var", "quality"), ("primary_var", "science")):
        if column in has:
            same = (F.col(column) != "") & (n == normalized(leaf(column)))
            verdict = F.when(F.coalesce(same, F.lit(False)), out(role, "high")).otherwise(verdict)
    group = F.coalesce("group_path", group_of("name")) if "group_path" in has else group_of("name")
    return (
        inventory.withColumns({"leaf": bare, "group": group, "_verdict": verdict})
        .withColumns({"role": F.col("_verdict.role"), "confidence": F.col("_verdict.confidence")})
        .drop("_verdict")
    )


def inventory_counts(classified: DataFrame) -> DataFrame:
    """Variables per role and file, with the roles' display order."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")
    return classified.groupBy("file_id", "role").agg(F.count(F.lit(1)).alias("n")).withColumn("display_order", place)


def related_variables(plotted: DataFrame, classified: DataFrame) -> DataFrame:
    """Companions of each file's plotted variable: flag, uncertainty and context siblings.

    `plotted` holds (file_id, plotted, quality_flag_var). The spelling `<stem>uncertainty` wins over
    the other error suffixes, of which the first in the file counts.
    """
    rows = plotted.select("file_id", "plotted", "quality_flag_var").join(
        classified.select("file_id", "ordinal", "leaf", "role"), "file_id"
    )
    stem = normalized(leaf("plotted"))
    own = normalized("leaf")
    other = own != stem
    suffix = F.when(F.startswith(own, stem) & other, F.substr(own, F.length(stem) + 1))
    at = F.struct("ordinal", "leaf")
    found = rows.groupBy("file_id", "plotted", "quality_flag_var").agg(
        F.max(F.when(suffix == "uncertainty", at)).alias("_exact"),
        F.min(F.when(suffix.isin(UNCERTAINTY_SUFFIXES[1:]), at)).alias("_error"),
        F.array_sort(F.array_agg(F.when(other & (F.col("role") == "context"), at))).alias("_context"),
    )
    return found.select(
        "file_id", leaf("plotted").alias("variable"), leaf("quality_flag_var").alias("qa_sibling"),
        F.coalesce("_exact.leaf", "_error.leaf").alias("uncertainty_sibling"),
        F.transform(F.array_compact("_context"), lambda s: s["leaf"]).alias("context_siblings"),
    )


# --- The variable a file is about -----------------------------------------------------------------

def _table_rank(text: Column, table: dict[str, int]) -> Column:
    return F.least(*[F.when(F.contains(text, F.lit(token)), rank).otherwise(UNRANKED) for token, rank in table.items()])


def score_variables(inventory: DataFrame) -> DataFrame:
    """Category, score, coverage decile and tie-breaking ranks of each variable.

    Needs `n_cells` and `n_valid`; an optional `requested` names the variable a caller asked for.
    """
    bare, low = leaf("name"), F.lower("name")
    flagged = F.col("flag_values").isNotNull() & F.col("flag_meanings").isNotNull()
    plumbing = flagged | bare.isin(PLUMBING_LEAVES) | F.col("name").rlike("(?i)" + "|".join(PLUMBING_PATTERNS))
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("standard_name", F.lit("")), F.coalesce("long_name", F.lit(""))))
    mean_leaf, has_units = bare == "Mean", F.coalesce(F.col("units") != "", F.lit(False))
    has_standard = F.coalesce(F.col("standard_name") != "", F.lit(False))
    points = lambda cond, p: F.when(cond, p).otherwise(0)
    score = (
        points(mean_leaf, SCORE_MEAN) + points(has_units, SCORE_UNITS) + points(contains_any(text, GEOPHYSICAL_ROOTS), SCORE_GEOPHYSICAL)
        + points(has_standard, SCORE_STANDARD_NAME) + points(F.coalesce(F.col("long_name") != "", F.lit(False)), SCORE_LONG_NAME)
        + points(plumbing, SCORE_PLUMBING)
    )
    if "requested" in inventory.columns:
        asked = F.lower(F.trim("requested"))
        hit = (asked != "") & (
            (asked == low) | (asked == F.lower(bare)) | (leaf(asked) == F.lower(bare)) | F.contains(low, asked)
        )
        hit = F.coalesce(hit, F.lit(False))
    else:
        hit = F.lit(False)
    joined = F.replace(low, F.lit(" "), F.lit(""))
    fraction = F.coalesce(F.try_divide("n_valid", "n_cells"), F.lit(0.0))
    return inventory.withColumns({
        "is_plumbing": plumbing, "requested_here": hit, "score": score, "valid_fraction": fraction,
        "decile": coverage_decile(fraction), "strong": mean_leaf | has_units | has_standard,
        "sensor_rank": _table_rank(joined, SENSOR_RANK), "algorithm_rank": _table_rank(joined, ALGORITHM_RANK),
        "label": F.coalesce(F.nullif(F.trim(F.coalesce("long_name", F.lit(""))), F.lit("")), F.col("name")),
    })


def _candidates(scored: DataFrame) -> DataFrame:
    eligible = ~F.col("is_plumbing") | F.col("requested_here")
    return scored.where(eligible & ((F.col("valid_fraction") > 0) | F.col("requested_here")))


def excluded_empty(inventory: DataFrame) -> DataFrame:
    """Science candidates left out because they hold no data, per file."""
    scored = score_variables(inventory)
    left_out = (~F.col("is_plumbing") | F.col("requested_here")) & (F.col("valid_fraction") <= 0) & ~F.col("requested_here")
    return scored.groupBy("file_id").agg(F.count_if(left_out).alias("excluded_empty"))


def _rank_key() -> list[Column]:
    return [(-F.col("decile")).alias("d"), (-F.col("score")).alias("s"), F.col("sensor_rank"), F.col("algorithm_rank"), F.col("name")]


def rank_variables(inventory: DataFrame) -> DataFrame:
    """Candidates of each file in order: coverage decile, score, sensor, algorithm, name.

    Decile and score cut a file into buckets, so a file of any size is never sorted in one task.
    """
    candidates = _candidates(score_variables(inventory))
    bucket = (10 - F.col("decile")) * 1000 + (500 - F.col("score"))
    ranked = order_stats.ordinal(candidates, ["file_id"], bucket, ["sensor_rank", "algorithm_rank", "name"], "_rank")
    return ranked.select("file_id", (F.col("_rank") + 1).alias("rank"), "name", "decile", "score", "valid_fraction")


def resolve_variable(inventory: DataFrame) -> DataFrame:
    """One variable per file with confidence and ambiguity, or none rather than a guess."""
    scored = score_variables(inventory)
    eligible = ~F.col("is_plumbing") | F.col("requested_here")
    candidate = eligible & ((F.col("valid_fraction") > 0) | F.col("requested_here"))
    pickable = candidate & (F.col("decile") > 0)
    serious = pickable & F.col("strong") & ~F.col("is_plumbing")
    key = F.struct(*_rank_key(), "label", "strong")
    per_decile = scored.groupBy("file_id", "decile").agg(
        F.min(F.when(candidate & F.col("requested_here"), key)).alias("_asked"),
        F.min(F.when(pickable, key)).alias("_top"), F.count_if(pickable).alias("_n"),
        F.count_if(serious).alias("_serious"),
        F.count_if(eligible & (F.col("valid_fraction") <= 0) & ~F.col("requested_here")).alias("_empty"),
    )
    files = per_decile.groupBy("file_id").agg(
        F.min("_asked").alias("_asked"), F.min("_top").alias("_top"), F.sum("_n").alias("_n"), F.sum("_empty").alias("excluded_empty"),
        F.max(F.when(F.col("_n") > 0, F.struct("decile", "_serious"))).alias("_best"),
    )
    # All the products a file could be about, in order: bounded by the file's variables.
    rivals = scored.where(serious).groupBy("file_id").agg(F.array_sort(F.array_agg(F.struct(*_rank_key(), "label"))).alias("_rivals"))
    files = files.join(rivals, "file_id", "left")
    asked, strong_top = F.col("_asked").isNotNull(), F.coalesce("_top.strong", F.lit(False))
    ambiguous = strong_top & (F.col("_best._serious") >= 2) & ~asked
    single = (F.col("_n") == 1) & ~strong_top & ~asked
    others = F.filter("_rivals", lambda r: (r["name"] != F.col("_top.name")) & (-r["d"] == F.col("_best.decile")))
    labels = F.filter(F.transform(others, lambda r: r["label"]), lambda t: t != F.col("_top.label"))
    first = F.concat(F.col("_top.label"), F.lit(" ranks first among the variables with data"))
    note = F.when(ambiguous & (F.size(labels) > 0), F.concat(first, F.lit("; the file could as well be about "), F.array_join(labels, ", "))).when(ambiguous | single, first)
    return files.select(
        "file_id",
        F.when(asked, F.col("_asked.name")).when(strong_top | single, F.col("_top.name")).alias("variable"),
        F.when(asked | strong_top, "high").when(single, "medium").otherwise("low").alias("resolution_confidence"),
        F.when(ambiguous, "high").otherwise("low").alias("scientific_ambiguity"),
        note.alias("disclosure"), "excluded_empty",
    )


# --- Registry -------------------------------------------------------------------------------------

def registry_failures(registry: DataFrame, reported: Column | None = None) -> DataFrame:
    """Registry rows that break a constraint, with all of their failures together.

    `reported` lists columns of the row whose fault is known already; those do not count as missing.
    """
    told = F.array().cast("array<string>") if reported is None else reported
    missing = lambda c: F.when((F.coalesce(F.col(c).cast("string"), F.lit("")) == "") & ~F.array_contains(told, F.lit(c)), F.concat(F.lit(c), F.lit(" is required")))
    checks = [missing(c) for c in ("collection_id", "primary_var", "units", "fill_value", "valid_min", "valid_max")]
    checks.append(F.when(~F.coalesce(F.col("cadence").isin("hourly", "daily", "monthly"), F.lit(False)), F.lit("cadence is unknown")))
    checks.append(F.when(F.col("valid_min") > F.col("valid_max"), F.lit("valid_min must be <= valid_max")))
    failures = F.array_compact(F.array(*checks))
    return registry.select("registry_key", F.array_join(failures, "; ").alias("failures")).where(F.col("failures") != "")


def registry_qa_audit(registry: DataFrame, flagless: DataFrame) -> DataFrame:
    """Collections whose quality story is not stated, or stated twice.

    Every collection either pins a flag variable or is listed in `flagless` (registry_key, reason).
    """
    listed = flagless.select("registry_key", F.lit(True).alias("_listed"))
    rows = registry.select("registry_key", F.coalesce(F.col("quality_flag_var") != "", F.lit(False)).alias("_pinned")).join(listed, "registry_key", "left")
    on_list = F.coalesce("_listed", F.lit(False))
    status = F.when(~F.col("_pinned") & ~on_list, "unaccounted").when(F.col("_pinned") & on_list, "contradiction")
    return rows.select("registry_key", status.alias("status")).where(F.col("status").isNotNull())

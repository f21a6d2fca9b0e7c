"""Masking of cells by fill value, valid range and quality flag, and the facts that steer it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.functions.scalars import leaf

# --- Fixed values: vocabularies and disclosed statuses ------------------------------------------
GOOD_TOKENS = [
    "good", "good_quality", "high_quality", "best", "best_quality",
    "normal", "valid", "clear", "confident_quality", "high_confidence",
]
BAD_TOKENS = [
    "bad", "bad_quality", "poor_quality", "low_quality", "missing",
    "no_data", "nodata", "fill", "fill_value", "invalid", "cloudy",
    "not_confident_quality", "error", "failed_quality",
]
TIER_REGISTRY = "collections_yaml"
TIER_DESCRIPTION = "umm_var"
TIER_FILE = "cf_attrs"
TIER_NONE = "none"
TIER_FLAG_MEANINGS = "cf_flag_meanings"
QA_VERIFIED = "verified"
QA_DETERMINISTIC = "cf-deterministic"
QA_INFERRED = "inferred, not verified"
QA_PENDING = "ambiguous — awaiting classification"
QA_NOT_APPLIED = "not applied — semantics unknown"
QA_NO_FLAG_VARIABLE = "not applied — this product publishes no quality flag variable"
# ------------------------------------------------------------------------------------------------


def is_fill(df: DataFrame, value: str, fill: float | Column) -> Column:
    """Whether a cell holds the fill value, compared in the column's own type.

    Integer-valued fills are exact sentinels; others allow for storage drift.
    """
    own = df.schema[value].dataType
    v = F.col(value)
    fill = F.lit(float(fill)) if isinstance(fill, (int, float)) else fill
    near = F.abs(v - fill) <= F.lit(1e-9) + F.lit(1e-6) * F.abs(fill)
    same = v == (fill.cast(own) if isinstance(own, (T.FloatType, T.DoubleType)) else fill)
    return F.when(fill == F.floor(fill), same).otherwise(near)


def fill_mask(df: DataFrame, fill: float | Column, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(~F.coalesce(is_fill(df, value, fill), F.lit(False)), F.col(value)))


def in_range(value: Column, vmin: float | Column | None, vmax: float | Column | None) -> Column:
    """Inclusive range test; an absent bound does not limit."""
    cond = F.lit(True)
    for bound, above in ((vmin, True), (vmax, False)):
        if bound is None:
            continue
        bound = bound if isinstance(bound, Column) else F.lit(float(bound))
        cond = cond & (bound.isNull() | ((value >= bound) if above else (value <= bound)))
    return cond


def valid_range_mask(df: DataFrame, vmin=None, vmax=None, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(in_range(F.col(value), vmin, vmax), F.col(value)))


def decode_flag_fill(df: DataFrame, fill=None, vmin=None, vmax=None, flag: str = "qa_flag") -> DataFrame:
    """A flag's own fill and out-of-range codes mean unknown quality, never good quality."""
    if fill is not None:
        df = fill_mask(df, fill, flag)
    return valid_range_mask(df, vmin, vmax, flag)


def passes_qa(flag: Column | str, good: Sequence[int] | None = None, bad: Sequence[int] | None = None) -> Column:
    """True when the flag counts as good; a missing flag never passes."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    if good is not None:
        return F.coalesce(flag.isin(*good), F.lit(False))
    return flag.isNotNull() & ~F.coalesce(flag.isin(*(bad or [])), F.lit(False))


def qa_mask(df: DataFrame, good=None, bad=None, value: str = "value", flag: str = "qa_flag") -> DataFrame:
    return df.withColumn(value, F.when(passes_qa(flag, good, bad), F.col(value)))


def mask_cells(
    df: DataFrame, *, raw: str = "raw_value", fill=None, vmin=None, vmax=None, good=None, bad=None,
    flag: str = "qa_flag",
) -> DataFrame:
    """All masks in order. `checked` holds the value before the flag test, `value` after it.

    Both stay columns of the same row, so counters and reductions share one scan.
    """
    out = df.withColumn("checked", F.col(raw))
    if fill is not None:
        out = fill_mask(out, fill, "checked")
    out = valid_range_mask(out, vmin, vmax, "checked")
    passed = passes_qa(flag, good, bad) if (good is not None or bad is not None) else F.lit(True)
    return out.withColumn("value", F.when(passed, F.col("checked")))


def scale_packed_bounds(df: DataFrame) -> DataFrame:
    """Bounds from file attributes are packed; bring them to physical units, in order."""
    packed = (F.col("valid_range_source") == TIER_FILE) & (
        F.col("scale_factor").isNotNull() | F.col("add_offset").isNotNull()
    )
    s, o = F.coalesce("scale_factor", F.lit(1.0)), F.coalesce("add_offset", F.lit(0.0))
    lo, hi = F.col("valid_min") * s + o, F.col("valid_max") * s + o
    both = lo.isNotNull() & hi.isNotNull()
    return df.withColumns({
        "valid_min": F.when(packed, F.when(both, F.least(lo, hi)).otherwise(lo)).otherwise(F.col("valid_min")),
        "valid_max": F.when(packed, F.when(both, F.greatest(lo, hi)).otherwise(hi)).otherwise(F.col("valid_max")),
    })


def resolve_mask_facts(df: DataFrame) -> DataFrame:
    """Fill, valid range and units by tier: registry, then description, then file attributes.

    A tier that states either bound wins both. Reads `reg_*`, `umm_*`, `cf_*` columns.
    """
    fill_source = (
        F.when(F.col("reg_fill").isNotNull(), TIER_REGISTRY)
        .when(F.col("umm_fill").isNotNull(), TIER_DESCRIPTION)
        .when(F.col("cf_fill").isNotNull(), TIER_FILE)
        .otherwise(TIER_NONE)
    )
    reg = F.col("reg_min").isNotNull() | F.col("reg_max").isNotNull()
    umm = F.col("umm_min").isNotNull() | F.col("umm_max").isNotNull()
    cf = F.col("cf_min").isNotNull() | F.col("cf_max").isNotNull()
    pair = F.col("cf_range_min").isNotNull() & F.col("cf_range_max").isNotNull()

    def bound(side: str) -> Column:
        return (
            F.when(reg, F.col(f"reg_{side}"))
            .when(umm, F.col(f"umm_{side}"))
            .when(cf, F.col(f"cf_{side}"))
            .when(pair, F.col(f"cf_range_{side}"))
        )

    range_source = (
        F.when(reg, TIER_REGISTRY).when(umm, TIER_DESCRIPTION).when(cf | pair, TIER_FILE).otherwise(TIER_NONE)
    )
    filled = df.withColumns({
        "fill_value": F.coalesce("reg_fill", "umm_fill", "cf_fill"),
        "fill_value_source": fill_source,
        "valid_min": bound("min"),
        "valid_max": bound("max"),
        "valid_range_source": range_source,
        "units": F.coalesce(F.nullif("reg_units", F.lit("")), F.nullif("umm_units", F.lit("")), "cf_units"),
    })
    known = F.col("fill_value").isNotNull() | F.col("valid_min").isNotNull() | F.col("valid_max").isNotNull()
    return filled.withColumn("applied", known)


def match_collection(descriptions: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry row of each description: by collection id over all rows first, then by short name."""
    by_id = registry.groupBy(F.col("collection_id").alias("concept_id")).agg(
        F.min_by("registry_key", "key_no").alias("_by_id")
    )
    by_name = registry.where(F.col("short_name") != "").groupBy(F.upper("short_name").alias("_name")).agg(
        F.min_by("registry_key", "key_no").alias("_by_name")
    )
    return (
        descriptions.withColumn("_name", F.upper("short_name"))
        .join(by_id, "concept_id", "left")
        .join(by_name, "_name", "left")
        .withColumn("registry_key", F.coalesce("_by_id", "_by_name"))
        .drop("_name", "_by_id", "_by_name")
    )


def _words(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed != "", F.split(trimmed, " ")).otherwise(F.array().cast("array<string>"))


def _token(t: Column) -> Column:
    return F.replace(F.lower(F.btrim(F.btrim(F.trim(t), F.lit('"')), F.lit("'"))), F.lit(" "), F.lit("_"))


def parse_flag_meanings(df: DataFrame, values: str = "flag_values", meanings: str = "flag_meanings") -> DataFrame:
    """Pair flag values with meaning tokens by position and sort them into good, bad and ambiguous.

    Anything malformed, or lists of different length, is not available. Row-local: no shuffle.
    """
    numbers = F.transform(
        _words(F.replace(F.coalesce(F.col(values), F.lit("")), F.lit(","), F.lit(" "))),
        lambda x: x.try_cast("double").try_cast("int"),
    )
    tokens = _words(F.coalesce(F.col(meanings), F.lit("")))
    out = df.withColumns({"_v": numbers, "_t": tokens})
    ok = (F.size("_v") > 0) & (F.size("_v") == F.size("_t")) & ~F.exists("_v", lambda v: v.isNull())
    out = out.withColumn("available", ok).withColumn(
        "_pairs", F.when(ok, F.zip_with("_v", "_t", lambda v, t: F.struct(v.alias("v"), t.alias("t"))))
    )
    good = lambda p: _token(p["t"]).isin(*GOOD_TOKENS)
    bad = lambda p: _token(p["t"]).isin(*BAD_TOKENS)
    open_ = lambda p: ~good(p) & ~bad(p)
    return out.withColumns({
        "good_values": F.transform(F.filter("_pairs", good), lambda p: p["v"]),
        "bad_values": F.transform(F.filter("_pairs", bad), lambda p: p["v"]),
        "ambiguous_tokens": F.transform(F.filter("_pairs", open_), lambda p: p["t"]),
        "ambiguous_values": F.transform(F.filter("_pairs", open_), lambda p: p["v"]),
    }).drop("_v", "_t", "_pairs")


def resolve_qa(df: DataFrame) -> DataFrame:
    """Which flag values count as good, and why.

    Reads `pinned_good`, `pinned_bad`, `proposed_tokens` and the columns of `parse_flag_meanings`.
    An empty pinned list is no rule. Adds `qa_good_values`, `qa_bad_values`, `qa_status`, `qa_source`.
    """
    has_good = F.coalesce(F.size("pinned_good") > 0, F.lit(False))
    has_bad = F.coalesce(F.size("pinned_bad") > 0, F.lit(False))
    clear = F.size("ambiguous_tokens") == 0
    some_good = F.size("good_values") > 0
    proposed = F.coalesce(F.size("proposed_tokens") > 0, F.lit(False))
    wanted = F.transform("proposed_tokens", _token)
    accepted = F.transform(
        F.filter(
            F.zip_with("ambiguous_values", "ambiguous_tokens", lambda v, t: F.struct(v.alias("v"), t.alias("t"))),
            lambda p: F.array_contains(wanted, _token(p["t"])),
        ),
        lambda p: p["v"],
    )
    pinned = has_good | has_bad
    return df.withColumns({
        "qa_status": F.when(pinned, QA_VERIFIED)
        .when(~F.col("available"), QA_NOT_APPLIED)
        .when(clear & some_good, QA_DETERMINISTIC)
        .when(clear, QA_PENDING)
        .when(proposed, QA_INFERRED)
        .otherwise(QA_PENDING),
        "qa_source": F.when(pinned, TIER_REGISTRY).when(~F.col("available"), TIER_NONE).otherwise(TIER_FLAG_MEANINGS),
        "qa_good_values": F.when(has_good, F.col("pinned_good"))
        .when(pinned | ~F.col("available"), None)
        .when(clear & some_good, F.col("good_values"))
        .when(~clear & proposed, F.concat("good_values", accepted)),
        "qa_bad_values": F.when(~has_good & has_bad, F.col("pinned_bad")),
    })


def honest_qa(df: DataFrame) -> DataFrame:
    """The status of `resolve_qa` as it will come true, and `qa_applies`.

    Reads `flag_variable`, NULL when the product publishes none, and `flag_present`, whether its band
    is in the cells. A rule without its band is not applied; without a flag variable there is no rule to find.
    """
    rule = F.coalesce(F.size("qa_good_values") > 0, F.lit(False)) | F.coalesce(F.size("qa_bad_values") > 0, F.lit(False))
    applies = rule & F.col("flag_variable").isNotNull() & F.coalesce("flag_present", F.lit(False))
    claimed = F.col("qa_status").isin(QA_VERIFIED, QA_DETERMINISTIC, QA_INFERRED)
    status = F.when(claimed & ~applies, QA_NOT_APPLIED).otherwise(F.col("qa_status"))
    return df.withColumn("qa_applies", applies).withColumn(
        "qa_status", F.when(F.col("flag_variable").isNull() & (status == QA_NOT_APPLIED), QA_NO_FLAG_VARIABLE).otherwise(status)
    )


def mask_by_facts(
    cells: DataFrame, facts: DataFrame, keys: Sequence[str] = ("collection",), raw: str = "raw_value", flag: str = "qa_flag"
) -> DataFrame:
    """Cells of many products, each masked by its own facts, in one plan: `checked` before the flag, `value` after it.

    `facts` has one row per key: `fill_value`, `valid_min`, `valid_max` in physical units, and the columns
    of `resolve_qa` after `honest_qa`. Cells of a product without facts stay as they are, unmasked and with
    NULL statuses. The join is on the product alone and left to Spark, which sends the facts to the
    cells when it finds them small.
    """
    told = ["fill_value", "valid_min", "valid_max", "qa_good_values", "qa_bad_values", "qa_applies", "qa_status", "qa_source"]
    facts = facts.select(*keys, F.struct(*told).alias("_f"))
    joined = cells.join(facts, list(keys), "left").withColumn("checked", F.when(~F.isnan(raw), F.col(raw)))
    shown = fill_mask(joined, F.col("_f.fill_value"), "checked")
    shown = valid_range_mask(shown, F.col("_f.valid_min"), F.col("_f.valid_max"), "checked")
    good, bad, code = F.col("_f.qa_good_values"), F.col("_f.qa_bad_values"), F.col(flag)
    # as in `passes_qa`: good values settle it, else everything but the bad ones; a missing flag never passes
    passed = F.when(good.isNotNull(), F.array_contains(good, code.cast("int"))).otherwise(
        ~F.coalesce(F.array_contains(bad, code.cast("int")), F.lit(False)))
    kept = ~F.coalesce("_f.qa_applies", F.lit(False)) | (code.isNotNull() & F.coalesce(passed, F.lit(False)))
    return shown.withColumn("value", F.when(kept, F.col("checked"))).withColumns(
        {"qa_status": F.col("_f.qa_status"), "qa_source": F.col("_f.qa_source")}
    ).drop("_f")


def qa_flag_variable(science: DataFrame, inventory: DataFrame) -> DataFrame:
    """The quality-flag variable of each file's science variable, or NULL.

    A pinned name settles it (NULL when the file lacks it); else the first ancillary reference the
    file holds; else the only other variable with both flag attributes.
    """
    rows = science.join(inventory.select("file_id", "name", "flag_values", "flag_meanings"), "file_id")
    position = F.array_position(F.split(F.coalesce("ancillary", F.lit("")), " "), F.col("name"))
    flagged = (
        F.col("flag_values").isNotNull() & F.col("flag_meanings").isNotNull() & (F.col("name") != F.col("science"))
    )
    found = rows.groupBy("file_id", "science", "pinned").agg(
        F.max(F.when(F.col("name") == F.col("pinned"), F.col("name"))).alias("_pinned"),
        F.min(F.when(position > 0, F.struct(position.alias("p"), F.col("name")))).alias("_ancillary"),
        F.count(F.when(flagged, 1)).alias("_n"),
        F.min(F.when(flagged, F.col("name"))).alias("_only"),
    )
    pick = (
        F.when(F.col("pinned").isNotNull(), F.col("_pinned"))
        .when(F.col("_ancillary").isNotNull(), F.col("_ancillary.name"))
        .when(F.col("_n") == 1, F.col("_only"))
    )
    return found.select("file_id", "science", pick.alias("flag_variable"))


def subset_variables(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested variables plus the flag pinned for them, spelled as the request spells its variables.

    `requests` holds (request_id, variable); `registry` holds `quality_flag_var` and `leaves`, the
    bare names a collection answers to. Collections that answer alike are one row before the join.
    """
    pinned = (
        registry.where(F.col("quality_flag_var").isNotNull())
        .select("quality_flag_var", F.array_sort(F.array_distinct("leaves")).alias("leaves"))
        .distinct()
        .withColumn("flag_leaf", leaf("quality_flag_var"))
        .withColumn("leaf", F.explode("leaves"))
    )
    asked = requests.select("request_id", "variable", leaf("variable").alias("leaf")).distinct()
    has_flag = asked.select("request_id", F.col("leaf").alias("flag_leaf"))
    matched = (
        asked.join(pinned, "leaf")
        .groupBy("request_id", "quality_flag_var", "leaves", "flag_leaf")
        .agg(F.min(F.struct("leaf", "variable")).alias("m"))
        .join(has_flag, ["request_id", "flag_leaf"], "left_anti")
    )
    as_asked = F.col("m.variable")
    spelling = (
        F.when(F.instr(as_asked, "/") == 0, F.col("flag_leaf"))
        .when(F.instr(F.col("quality_flag_var"), "/") > 0, F.col("quality_flag_var"))
        .otherwise(F.concat(F.regexp_replace(as_asked, "/[^/]*$", ""), F.lit("/"), F.col("flag_leaf")))
    )
    added = matched.select("request_id", spelling.alias("variable"), F.lit(True).alias("added")).distinct()
    return asked.select("request_id", "variable", F.lit(False).alias("added")).unionByName(added)

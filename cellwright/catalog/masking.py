"""Registered queries: masking and its facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import FILL, GOOD, MASKED, VMAX, VMIN, as_text, masked_cells
from cellwright.catalog.fixtures import ctes, fixture
from cellwright.operators import masking as M

_ID = ["i", "j", "ts"]


def _cells(s, d):
    return fixture(s, d, "fx_cells").withColumnRenamed("raw_value", "value")


def _facts(s, d):
    return M.resolve_mask_facts(fixture(s, d, "fx_mask_tiers"))


_FACTS_SQL = """SELECT file_id, ordinal, name, coalesce(reg_fill, umm_fill, cf_fill) AS fill_value,
  CASE WHEN reg_fill IS NOT NULL THEN 'collections_yaml' WHEN umm_fill IS NOT NULL THEN 'umm_var'
       WHEN cf_fill IS NOT NULL THEN 'cf_attrs' ELSE 'none' END AS fill_value_source,
  CASE WHEN reg_min IS NOT NULL OR reg_max IS NOT NULL THEN reg_min WHEN umm_min IS NOT NULL OR umm_max IS NOT NULL THEN umm_min
       WHEN cf_min IS NOT NULL OR cf_max IS NOT NULL THEN cf_min ELSE cf_range_min END AS valid_min,
  CASE WHEN reg_min IS NOT NULL OR reg_max IS NOT NULL THEN reg_max WHEN umm_min IS NOT NULL OR umm_max IS NOT NULL THEN umm_max
       WHEN cf_min IS NOT NULL OR cf_max IS NOT NULL THEN cf_max ELSE cf_range_max END AS valid_max,
  CASE WHEN reg_min IS NOT NULL OR reg_max IS NOT NULL THEN 'collections_yaml' WHEN umm_min IS NOT NULL OR umm_max IS NOT NULL THEN 'umm_var'
       WHEN cf_min IS NOT NULL OR cf_max IS NOT NULL OR cf_range_min IS NOT NULL THEN 'cf_attrs' ELSE 'none' END AS valid_range_source,
  CASE WHEN reg_units <> '' THEN reg_units WHEN umm_units <> '' THEN umm_units ELSE cf_units END AS units, scale_factor, add_offset
FROM fx_mask_tiers"""

_PARSED_SQL = """SELECT file_id, ordinal, name, tokens, vals,
  len(vals) > 0 AND len(vals) = len(tokens) AS available,
  list_transform(generate_series(1, len(vals)), lambda k:
     CASE WHEN tokens[k] IN ('normal', 'good_quality', 'best') THEN 'g'
          WHEN tokens[k] IN ('bad', 'cloudy', 'missing', 'fill') THEN 'b' ELSE 'a' END) AS kinds
FROM (SELECT *, CASE WHEN flag_values IS NULL THEN [] ELSE regexp_split_to_array(replace(flag_values, ',', ''), ' ') END AS vals,
        CASE WHEN flag_meanings IS NULL THEN [] ELSE string_split(flag_meanings, ' ') END AS tokens FROM fx_inventory)"""
_PICK = "list_filter(generate_series(1, len(vals)), lambda k: kinds[k] = '{}')"
_LISTS_SQL = f"""SELECT *,
  CASE WHEN available THEN list_transform({_PICK.format('g')}, lambda k: vals[k]) END AS g,
  CASE WHEN available THEN list_transform({_PICK.format('b')}, lambda k: vals[k]) END AS b,
  CASE WHEN available THEN list_transform({_PICK.format('a')}, lambda k: vals[k]) END AS av,
  CASE WHEN available THEN list_transform({_PICK.format('a')}, lambda k: tokens[k]) END AS atk FROM parsed"""


def _joined(df, *names):
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in names})


def _parsed(s, d):
    return M.parse_flag_meanings(fixture(s, d, "fx_inventory"))


def _resolve_qa(s, d):
    registry = fixture(s, d, "fx_collections").select(F.col("key_no").alias("file_id"), "qa_good_values", "qa_bad_values")
    # Registry rows of the files whose number divides by three, so every tier occurs.
    registry = registry.where(F.col("file_id") % 3 == 0)
    to_ints = lambda c: F.when(F.col(c) == "", F.array().cast("array<int>")).otherwise(F.split(c, ",").cast("array<int>"))
    rows = _parsed(s, d).join(registry, "file_id", "left").withColumns({
        "pinned_good": to_ints("qa_good_values"), "pinned_bad": to_ints("qa_bad_values"),
        "proposed_tokens": F.when(F.col("ordinal") % 2 == 0, F.array(F.lit("Suspicious"), F.lit("extra"))),
    }).drop("qa_good_values", "qa_bad_values")
    out = M.resolve_qa(rows).select("file_id", "ordinal", "qa_status", "qa_source", "qa_good_values", "qa_bad_values")
    return _joined(out, "qa_good_values", "qa_bad_values")


def _match(s, d):
    return M.match_collection(fixture(s, d, "fx_descriptions"), fixture(s, d, "fx_collections")).select("description_id", "registry_key")


def _subset(s, d):
    registry = fixture(s, d, "fx_collections").select(
        "quality_flag_var", F.array("primary_var", F.lit("terrain_height")).alias("leaves"))
    return M.subset_variables(fixture(s, d, "fx_requests"), registry)


def _facts_by_collection(s, d):
    """Every registry row as a product of its own; some lack the flag, some the band it names."""
    registry = fixture(s, d, "fx_collections")
    to_ints = lambda c: F.when(F.col(c) != "", F.split(c, ",").cast("array<int>"))
    none = F.lit(None)
    rows = registry.select(
        F.col("registry_key").alias("collection"), "key_no", F.col("quality_flag_var").alias("flag_variable"), (F.col("key_no") % 5 > 0).alias("flag_present"),
        F.col("fill_value").alias("reg_fill"), F.col("valid_min").alias("reg_min"), F.col("valid_max").alias("reg_max"), F.col("units").alias("reg_units"),
        *[none.cast("double").alias(c) for c in ("umm_fill", "umm_min", "umm_max", "cf_min", "cf_max", "cf_range_min", "cf_range_max", "add_offset")],
        F.lit(-999.0).alias("cf_fill"), none.cast("string").alias("umm_units"), none.cast("string").alias("cf_units"), none.cast("double").alias("scale_factor"),
        to_ints("qa_good_values").alias("pinned_good"), to_ints("qa_bad_values").alias("pinned_bad"), none.cast("array<string>").alias("proposed_tokens"),
        F.when(F.col("key_no") % 3 == 0, "0 1 2").alias("flag_values"), F.when(F.col("key_no") % 3 == 0, "normal bad missing").alias("flag_meanings"),
    )
    return M.honest_qa(M.resolve_qa(M.parse_flag_meanings(M.scale_packed_bounds(M.resolve_mask_facts(rows)))))


def _mask_by_facts(s, d):
    cells = fixture(s, d, "fx_cells").withColumn("collection", F.concat(F.lit("K"), (F.col("i") + 1).cast("string")))
    out = M.mask_by_facts(cells, _facts_by_collection(s, d))
    return as_text(out.select("collection", *_ID, "checked", "value", "qa_status", "qa_source"), "ts")


QUERIES = {
    "mask_by_facts": (
        _mask_by_facts,
        ctes("fx_cells", "fx_collections", rules="""SELECT *, registry_key AS collection, key_no % 5 > 0 AND quality_flag_var IS NOT NULL AS reached, qa_good_values <> '' AS g, qa_bad_values <> '' AS b FROM fx_collections""",
             ruled="""SELECT *, coalesce(g, false) OR coalesce(b, false) AS pinned, key_no % 3 = 0 AS parsed FROM rules""",
             seen="""SELECT c.*, r.* EXCLUDE (collection, fill_value, valid_min, valid_max), CASE WHEN raw_value <> coalesce(r.fill_value, -999)
               AND (valid_min IS NULL OR raw_value >= valid_min) AND ((valid_max IS NULL) OR raw_value <= valid_max) THEN raw_value END AS checked
               FROM (SELECT i, j, ts, raw_value, qa_flag, concat('K', i + 1) AS collection FROM fx_cells) c JOIN ruled r USING (collection)""")
        + """SELECT collection, i, j, CAST(ts AS VARCHAR) AS ts, checked, CASE WHEN NOT reached OR NOT (pinned OR parsed) THEN checked
          WHEN coalesce(g, false) AND qa_flag = 0 OR NOT coalesce(g, false) AND coalesce(b, false) AND qa_flag NOT IN (1, 2) OR NOT pinned AND qa_flag = 0 THEN checked END AS value,
        CASE WHEN (pinned OR parsed) AND reached THEN CASE WHEN pinned THEN 'verified' ELSE 'cf-deterministic' END
             WHEN quality_flag_var IS NULL THEN 'not applied — this product publishes no quality flag variable' ELSE 'not applied — semantics unknown' END AS qa_status,
        CASE WHEN pinned THEN 'collections_yaml' WHEN parsed THEN 'cf_flag_meanings' ELSE 'none' END AS qa_source FROM seen""",
    ),
    "fill_mask": (
        lambda s, d: as_text(M.fill_mask(_cells(s, d), FILL).select(*_ID, "value"), "ts"),
        ctes("fx_cells") + """SELECT i, j, CAST(ts AS VARCHAR) AS ts,
        CASE WHEN raw_value = -999 THEN NULL ELSE raw_value END AS value FROM fx_cells""",
    ),
    "valid_range_mask": (
        lambda s, d: as_text(M.valid_range_mask(_cells(s, d), VMIN, VMAX).select(*_ID, "value"), "ts"),
        ctes("fx_cells") + """SELECT i, j, CAST(ts AS VARCHAR) AS ts,
        CASE WHEN raw_value >= 2 AND raw_value <= 100 THEN raw_value END AS value FROM fx_cells""",
    ),
    "decode_flag_fill": (
        lambda s, d: as_text(M.decode_flag_fill(_cells(s, d), fill=2, vmin=0, vmax=5).select(*_ID, F.col("qa_flag").cast("double")), "ts"),
        ctes("fx_cells") + """SELECT i, j, CAST(ts AS VARCHAR) AS ts,
        CAST(CASE WHEN qa_flag = 2 OR qa_flag NOT BETWEEN 0 AND 5 THEN NULL ELSE qa_flag END AS DOUBLE) AS qa_flag FROM fx_cells""",
    ),
    "qa_mask": (
        lambda s, d: as_text(M.qa_mask(_cells(s, d), good=GOOD).select(*_ID, "value", F.lit("good").alias("rule"))
                             .unionByName(M.qa_mask(M.decode_flag_fill(_cells(s, d), fill=1), bad=[2]).select(*_ID, "value", F.lit("bad").alias("rule"))), "ts"),
        ctes("fx_cells") + """SELECT i, j, CAST(ts AS VARCHAR) AS ts, CASE WHEN qa_flag = 0 THEN raw_value END AS value, 'good' AS rule FROM fx_cells
        UNION ALL SELECT i, j, CAST(ts AS VARCHAR), CASE WHEN nullif(qa_flag, 1) NOT IN (2) THEN raw_value END, 'bad' FROM fx_cells""",
    ),
    "mask_cells": (
        lambda s, d: as_text(masked_cells(s, d).select(*_ID, "checked", "value"), "ts"),
        ctes("fx_cells", masked=MASKED) + "SELECT i, j, CAST(ts AS VARCHAR) AS ts, checked, value FROM masked",
    ),
    "resolve_mask_facts": (
        lambda s, d: _facts(s, d).select("file_id", "ordinal", "fill_value", "fill_value_source", "valid_min", "valid_max",
                                         "valid_range_source", "units", "applied"),
        ctes("fx_mask_tiers", facts=_FACTS_SQL) + """SELECT file_id, ordinal, fill_value, fill_value_source, valid_min, valid_max,
        valid_range_source, units, fill_value IS NOT NULL OR valid_min IS NOT NULL OR valid_max IS NOT NULL AS applied FROM facts""",
    ),
    "scale_packed_bounds": (
        lambda s, d: M.scale_packed_bounds(_facts(s, d)).select("file_id", "ordinal", "valid_min", "valid_max"),
        ctes("fx_mask_tiers", facts=_FACTS_SQL, scaled="""SELECT *, valid_range_source = 'cf_attrs' AND (scale_factor IS NOT NULL OR add_offset IS NOT NULL) AS packed,
        valid_min * coalesce(scale_factor, 1) + coalesce(add_offset, 0) AS lo, valid_max * coalesce(scale_factor, 1) + coalesce(add_offset, 0) AS hi FROM facts""")
        + """SELECT file_id, ordinal, CASE WHEN NOT packed THEN valid_min WHEN lo > hi THEN hi ELSE lo END AS valid_min,
        CASE WHEN NOT packed THEN valid_max WHEN lo > hi THEN lo ELSE hi END AS valid_max FROM scaled""",
    ),
    "match_collection": (
        _match,
        ctes("fx_descriptions", "fx_collections") + """SELECT d.description_id, coalesce(a.registry_key, b.registry_key) AS registry_key FROM fx_descriptions d
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY key_no) AS rn FROM fx_collections) a ON a.collection_id = d.concept_id AND a.rn = 1
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY upper(short_name) ORDER BY key_no) AS rn FROM fx_collections) b ON upper(b.short_name) = upper(d.short_name) AND b.rn = 1""",
    ),
    "parse_flag_meanings": (
        lambda s, d: _joined(_parsed(s, d).select("file_id", "ordinal", "available", "good_values", "bad_values", "ambiguous_values", "ambiguous_tokens"),
                             "good_values", "bad_values", "ambiguous_values", "ambiguous_tokens"),
        ctes("fx_inventory", parsed=_PARSED_SQL, lists=_LISTS_SQL) + """SELECT file_id, ordinal, available, array_to_string(g, ',') AS good_values,
        array_to_string(b, ',') AS bad_values, array_to_string(av, ',') AS ambiguous_values, array_to_string(atk, ',') AS ambiguous_tokens FROM lists""",
    ),
    "resolve_qa": (
        _resolve_qa,
        ctes("fx_inventory", "fx_collections", parsed=_PARSED_SQL, lists=_LISTS_SQL,
             ruled="""SELECT l.*, CASE WHEN c.qa_good_values <> '' THEN c.qa_good_values END AS pg, CASE WHEN c.qa_bad_values <> '' THEN c.qa_bad_values END AS pb,
             l.ordinal % 2 = 0 AS proposed FROM lists l LEFT JOIN (SELECT * FROM fx_collections WHERE key_no % 3 = 0) c ON c.key_no = l.file_id""")
        + """SELECT file_id, ordinal,
        CASE WHEN pg IS NOT NULL OR pb IS NOT NULL THEN 'verified' WHEN NOT available THEN 'not applied — semantics unknown'
             WHEN len(atk) = 0 AND len(g) > 0 THEN 'cf-deterministic' WHEN len(atk) = 0 OR NOT proposed THEN 'ambiguous — awaiting classification'
             ELSE 'inferred, not verified' END AS qa_status,
        CASE WHEN pg IS NOT NULL OR pb IS NOT NULL THEN 'collections_yaml' WHEN NOT available THEN 'none' ELSE 'cf_flag_meanings' END AS qa_source,
        CASE WHEN pg IS NOT NULL THEN pg WHEN pb IS NOT NULL OR NOT available THEN NULL WHEN len(atk) = 0 AND len(g) > 0 THEN array_to_string(g, ',')
             WHEN len(atk) > 0 AND proposed THEN array_to_string(list_concat(g, list_transform(
               list_filter(generate_series(1, len(atk)), lambda k: atk[k] IN ('suspicious', 'extra')), lambda k: av[k])), ',') END AS qa_good_values,
        CASE WHEN pg IS NULL THEN pb END AS qa_bad_values FROM ruled""",
    ),
    "qa_flag_variable": (
        lambda s, d: M.qa_flag_variable(fixture(s, d, "fx_science"), fixture(s, d, "fx_inventory")),
        ctes("fx_science", "fx_inventory") + """SELECT s.file_id, s.science, CASE
          WHEN s.pinned IS NOT NULL THEN (SELECT max(v.name) FROM fx_inventory v WHERE v.file_id = s.file_id AND v.name = s.pinned)
          WHEN s.ancillary IS NOT NULL AND EXISTS (SELECT 1 FROM fx_inventory v WHERE v.file_id = s.file_id AND v.name IN ('product/main_data_quality_flag', 'support_data/main_data_quality_flag'))
            THEN (SELECT min(v.name) FROM fx_inventory v WHERE v.file_id = s.file_id AND v.name IN ('product/main_data_quality_flag', 'support_data/main_data_quality_flag'))
          WHEN (SELECT count(*) FROM fx_inventory v WHERE v.file_id = s.file_id AND v.flag_values IS NOT NULL AND v.flag_meanings IS NOT NULL AND v.name <> s.science) = 1
            THEN (SELECT min(v.name) FROM fx_inventory v WHERE v.file_id = s.file_id AND v.flag_values IS NOT NULL AND v.flag_meanings IS NOT NULL AND v.name <> s.science)
          END AS flag_variable FROM fx_science s""",
    ),
    "subset_variables": (
        _subset,
        ctes("fx_requests", "fx_collections", req="SELECT DISTINCT request_id, variable, list_last(string_split(variable, '/')) AS leaf FROM fx_requests",
             reg="""SELECT DISTINCT quality_flag_var, unnest([primary_var, 'terrain_height']) AS leaf, primary_var AS p FROM fx_collections WHERE quality_flag_var IS NOT NULL""",
             hit="""SELECT r.request_id, g.p, min([r.leaf, r.variable]) AS m FROM req r JOIN reg g ON r.leaf = g.leaf
               WHERE r.request_id NOT IN (SELECT request_id FROM req WHERE leaf = 'main_data_quality_flag') GROUP BY r.request_id, g.p""")
        + """SELECT request_id, variable, false AS added FROM req UNION ALL
        SELECT DISTINCT request_id, CASE WHEN contains(m[2], '/') THEN 'product/main_data_quality_flag' ELSE 'main_data_quality_flag' END, true FROM hit""",
    ),
}

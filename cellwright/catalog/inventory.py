"""Registered queries: variable inventories and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog.fixtures import ctes, fixture
from cellwright.operators import inventory as I
from cellwright.operators import masking as M
from cellwright.operators import reductions as D
from cellwright.operators import resolved as V
from cellwright.session import fresh_path
from cellwright.sources import collections as K


_BANDS = ["product/vertical_column_troposphere", "column_amount_o3", "Terra_darktarget/Mean", "cloud_fraction"]


def _products(s, d):
    """The daily grid as the files of a year each, of three products: every one with its own science band, and clouds in all."""
    year = F.year("ts")
    kind = year % 3
    cells = fixture(s, d, "fx_cells").select(
        year.alias("file_id"), F.col("ts").cast("timestamp").alias("ts"), "i", "j", "lat", "lon", F.when(kind == 0, F.col("raw_value")).alias(_BANDS[0]),
        F.when((kind == 1) | ((kind == 0) & (F.col("i") < 30)), F.col("value_uncertainty")).alias(_BANDS[1]), F.when(kind == 2, F.col("raw_value") * 2).alias(_BANDS[2]), F.col("cloud_fraction"))
    described = cells.select("file_id").distinct().select("file_id", F.explode(F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(b).alias("name"), F.lit("1" if n < 3 else None).alias("units")) for n, b in enumerate(_BANDS)])).alias("v"))
    empty = F.lit(None).cast("string")
    return cells, described.select("file_id", "v.*", *[empty.alias(c) for c in ("standard_name", "long_name", "flag_values", "flag_meanings")])


def _variable_read(s, d):
    cells, described = _products(s, d)
    resolved, own = V.resolve_files(cells, described, _BANDS)
    masked = M.mask_cells(own, fill=-999.0, vmin=0.5)
    stats = D.field_statistics(D.temporal_mean(masked, "monthly", ["file_id"]), ["file_id"]).select("file_id", "count", "mean", "max")
    return resolved.select("file_id", "variable", "resolution_confidence", "disclosure").join(stats, "file_id")


def _registry_file(s, d):
    """The registry written as a file, with torn lines, words for numbers, and names that several entries claim, and what is wrong with it."""
    path = fresh_path(s, "registry")
    c = fixture(s, d, "fx_collections")
    key, n = F.col("registry_key"), F.col("key_no")
    row = F.to_json(F.struct(
        F.when(n % 61 != 3, key).alias("registry_key"), "collection_id", "short_name", "cadence", "primary_var", "units",
        F.when(n % 89 == 7, "none").otherwise(F.col("fill_value").cast("string")).alias("fill_value"), F.col("valid_min").cast("string").alias("valid_min"), "valid_max",
        F.when(n % 71 == 4, F.array(F.lit("shared"))).otherwise(F.array(F.concat(F.lit("alias of "), key))).alias("aliases")))
    row = F.when(n % 97 == 5, F.concat(F.lit('{"registry_key": '), key)).otherwise(row)
    lines = c.select(F.explode(F.when(n % 83 == 9, F.array(row, row)).otherwise(F.array(row))).alias("value"))
    lines.write.text(path)
    return K.registry_problems(K.read_entries(s, path)).groupBy("failures").agg(F.count("*").alias("n"))


def _any(text: str, words, form: str) -> str:
    return "(" + " OR ".join(form.format(text=text, w=w) for w in words) + ")"


def _has(text, words):
    return _any(text, words, "contains({text}, '{w}')")


def _ends(text, words):
    return _any(text, words, "ends_with({text}, '{w}')")


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_LEAF = "list_last(string_split(name, '/'))"
_NAMED = f"""SELECT v.*, c.primary_var, c.quality_flag_var, {_LEAF} AS leaf, regexp_replace(lower({_LEAF}), '[^a-z0-9]', '', 'g') AS norm,
  lower(trim(coalesce(v.standard_name, ''))) AS sn, CASE WHEN contains(name, '/') THEN lower(split_part(name, '/', 1)) ELSE '' END AS grp
  FROM fx_inventory v LEFT JOIN (SELECT key_no, primary_var, quality_flag_var FROM fx_collections WHERE key_no % 2 = 0) c ON c.key_no = v.file_id"""
_CLASSIFIED = f"""SELECT *, split_part(rc, '|', 1) AS role, nullif(split_part(rc, '|', 2), '') AS confidence FROM (SELECT *, CASE
  WHEN norm = regexp_replace(lower(primary_var), '[^a-z0-9]', '', 'g') THEN 'science|high'
  WHEN quality_flag_var IS NOT NULL AND norm = 'maindataqualityflag' THEN 'quality|high'
  WHEN sn IN {_in(I.COORDINATE_STANDARD_NAMES)} THEN 'context|high' WHEN {_has('sn', I.QUALITY_STANDARD_NAMES)} THEN 'quality|high'
  WHEN {_has('sn', I.SCIENCE_STANDARD_NAMES)} THEN 'science|high' WHEN grp = 'qa_statistics' THEN 'quality|high' WHEN grp = 'geolocation' THEN 'context|high'
  WHEN norm IN {_in(I.COORDINATE_NAMES)} THEN 'context|high'
  WHEN {_has('norm', I.QUALITY_PARTS)} OR {_ends('norm', I.QUALITY_SUFFIXES)} THEN 'quality|medium'
  WHEN {_has('norm', I.GEOMETRY_PARTS)} THEN 'context|medium'
  WHEN starts_with(norm, 'amf') OR {_has('norm', I.RETRIEVAL_PARTS)} THEN 'retrieval-metadata|medium'
  WHEN {_has('norm', I.CONTEXT_PARTS)} THEN 'context|medium' WHEN grp IN ('product', 'key_science_data') THEN 'science|high'
  WHEN {_has('norm', I.SCIENCE_STEMS + I.SCIENCE_TOKENS)} THEN 'science|low' ELSE 'unclassified|' END AS rc FROM named)"""


def _registered(s, d):
    c = fixture(s, d, "fx_collections").where("key_no % 2 = 0").select(F.col("key_no").alias("file_id"), "primary_var", "quality_flag_var")
    return fixture(s, d, "fx_inventory").join(c, "file_id", "left")


def _classified(s, d):
    return I.classify_variables(_registered(s, d))


def _related(s, d):
    v = fixture(s, d, "fx_inventory")
    plotted = v.where("ordinal = 7").select("file_id", F.regexp_replace("name", "(_uncertainty|_precision|_std|Std)$", "").alias("plotted"))
    c = fixture(s, d, "fx_collections").select(F.col("key_no").alias("file_id"), "quality_flag_var")
    out = I.related_variables(plotted.join(c, "file_id", "left"), _classified(s, d))
    return out.withColumn("context_siblings", F.array_join("context_siblings", ","))


def _requested(s, d):
    """Every third file is asked for by leaf, every seventh by part of a name."""
    ask = F.when(F.col("file_id") % 3 == 0, "Pixel_Counts").when(F.col("file_id") % 7 == 0, " product/AOD ")
    return fixture(s, d, "fx_inventory").withColumn("requested", ask)


def _rank(text: str, table: dict) -> str:
    return "least(" + ", ".join(f"CASE WHEN contains({text}, '{t}') THEN {r} ELSE 99 END" for t, r in table.items()) + ")"


_SCORED = f"""SELECT *, {_LEAF} AS leaf, lower(name) AS low, CASE WHEN n_cells > 0 THEN n_valid / n_cells ELSE 0 END AS frac,
  (flag_values IS NOT NULL AND flag_meanings IS NOT NULL) OR {_LEAF} IN {_in(I.PLUMBING_LEAVES)}
    OR regexp_matches(lower(name), 'zenith_angle|azimuth_angle|scattering_angle|reflectance|land_ocean_mask|(^|[/_])mask($|[/_])|(^|[/_])ndvi($|[/_])|cloud_fraction|quality_flag|data_quality') AS plumbing,
  CASE WHEN file_id % 3 = 0 THEN 'pixel_counts' WHEN file_id % 7 = 0 THEN 'product/aod' END AS asked,
  coalesce(units <> '', false) OR coalesce(standard_name <> '', false) OR {_LEAF} = 'Mean' AS strong,
  {_rank("lower(name)", I.SENSOR_RANK)} AS sr, {_rank("lower(name)", I.ALGORITHM_RANK)} AS ar, coalesce(nullif(trim(coalesce(long_name, '')), ''), name) AS label
  FROM fx_inventory"""
_SC2 = f"""SELECT *, CASE WHEN leaf = 'Mean' THEN 100 ELSE 0 END + CASE WHEN units <> '' THEN 80 ELSE 0 END
  + CASE WHEN {_has("lower(concat_ws(' ', name, coalesce(standard_name, ''), coalesce(long_name, '')))", I.GEOPHYSICAL_ROOTS)} THEN 40 ELSE 0 END
  + CASE WHEN standard_name <> '' THEN 30 ELSE 0 END + CASE WHEN long_name <> '' THEN 20 ELSE 0 END + CASE WHEN plumbing THEN -60 ELSE 0 END AS score,
  CASE WHEN frac <= 0 THEN 0 ELSE least(10, CAST(floor(frac * 10) AS INT)) END AS decile,
  coalesce(asked = low OR asked = lower(leaf) OR list_last(string_split(asked, '/')) = lower(leaf) OR contains(low, asked), false) AS hit FROM sc"""
_CAND = """SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY decile DESC, score DESC, sr, ar, name) AS rank FROM sc2
  WHERE (NOT plumbing OR hit) AND (frac > 0 OR hit)"""
_RES = """SELECT f.file_id, (SELECT name FROM cand c WHERE c.file_id = f.file_id AND hit ORDER BY rank LIMIT 1) AS asked_name,
  (SELECT {'name': name, 'label': label, 'strong': strong, 'decile': decile, 'rank': rank} FROM cand c WHERE c.file_id = f.file_id AND decile > 0 ORDER BY rank LIMIT 1) AS top,
  (SELECT count(*) FROM cand c WHERE c.file_id = f.file_id AND decile > 0) AS n,
  (SELECT count(*) FROM sc2 c WHERE c.file_id = f.file_id AND NOT plumbing AND NOT hit AND frac <= 0) AS excluded_empty
  FROM (SELECT DISTINCT file_id FROM sc2) f"""
_RES2 = """SELECT r.*, (SELECT count(*) FROM cand c WHERE c.file_id = r.file_id AND c.strong AND NOT c.plumbing AND c.decile = r.top.decile) AS serious,
  (SELECT string_agg(label, ', ' ORDER BY rank) FROM cand c WHERE c.file_id = r.file_id AND c.strong AND NOT c.plumbing AND c.decile = r.top.decile AND c.name <> r.top.name
    AND label <> r.top.label) AS alts FROM res r"""

_AXIS = """SELECT file_id, ordinal, name, n_dims, is_dim, is_ref,
  trim(standard_name) IS NOT DISTINCT FROM 'latitude' OR coalesce(units IN ('degrees_north', 'degree_N'), false) AS mlat,
  trim(standard_name) IS NOT DISTINCT FROM 'longitude' OR coalesce(units IN ('degrees_east', 'degreesE'), false) AS mlon,
  standard_name IS NOT DISTINCT FROM 'time' OR axis IS NOT DISTINCT FROM 't' OR starts_with(dtype, 'datetime') AS mtime,
  ends_with(name, '_bnds') OR ends_with(name, '_edges') AS bnd FROM fx_axes"""


def _axis_sql(kind: str, names: list[str]) -> str:
    m = f"m{kind}"
    if kind == "time":
        order = f"CASE WHEN {m} THEN 0 ELSE 1 END, CASE WHEN {m} THEN CASE WHEN is_dim THEN 0 ELSE 1 END ELSE list_position({names}, name) END, ordinal"
    else:
        order = f"CASE WHEN is_ref THEN 0 ELSE 1 END, CASE WHEN {m} AND NOT bnd THEN 0 WHEN {m} THEN 1 ELSE 2 END, CASE WHEN {m} THEN n_dims ELSE list_position({names}, name) END, CASE WHEN is_dim THEN 0 ELSE 1 END, ordinal"
    return f"SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY {order}) AS rn FROM ax WHERE {m} OR name IN {_in(names)}"


def _axes_sql():
    return ctes("fx_axes", ax=_AXIS, la=_axis_sql("lat", I.LAT_NAMES), lo=_axis_sql("lon", I.LON_NAMES), ti=_axis_sql("time", I.TIME_NAMES)) + """
    SELECT f.file_id, la.name AS lat_var, lo.name AS lon_var, ti.name AS time_var FROM (SELECT DISTINCT file_id FROM ax) f
    LEFT JOIN la ON la.file_id = f.file_id AND la.rn = 1 LEFT JOIN lo ON lo.file_id = f.file_id AND lo.rn = 1 LEFT JOIN ti ON ti.file_id = f.file_id AND ti.rn = 1"""


def _flagless(s, d):
    return fixture(s, d, "fx_collections").where("key_no % 3 = 0").select("registry_key", F.lit("seen in a granule").alias("reason"))


QUERIES = {
    "identify_axes": (lambda s, d: I.identify_axes(fixture(s, d, "fx_axes")), _axes_sql()),
    "merge_group_variables": (
        lambda s, d: I.merge_group_variables(fixture(s, d, "fx_inventory")).select("file_id", "ordinal", "merged_name", "shadowed"),
        ctes("fx_inventory", g=f"""SELECT file_id, ordinal, name, {_LEAF} AS leaf, contains(name, '/') AS grouped FROM fx_inventory""",
             w="SELECT *, count(*) FILTER (grouped) OVER (PARTITION BY file_id, leaf) AS n, count(*) FILTER (NOT grouped) OVER (PARTITION BY file_id, leaf) AS roots FROM g")
        + "SELECT file_id, ordinal, CASE WHEN grouped AND n > 1 THEN name ELSE leaf END AS merged_name, grouped AND n = 1 AND roots > 0 AS shadowed FROM w",
    ),
    "classify_variables": (
        lambda s, d: _classified(s, d).select("file_id", "ordinal", "leaf", "group", "role", "confidence"),
        ctes("fx_inventory", "fx_collections", named=_NAMED, classified=_CLASSIFIED)
        + """SELECT file_id, ordinal, leaf, CASE WHEN contains(name, '/') THEN regexp_replace(name, '/[^/]*$', '') END AS "group", role, confidence FROM classified""",
    ),
    "inventory_counts": (
        lambda s, d: I.inventory_counts(_classified(s, d)),
        ctes("fx_inventory", "fx_collections", named=_NAMED, classified=_CLASSIFIED)
        + "SELECT file_id, role, count(*) AS n, CAST(list_position(['science', 'quality', 'context', 'retrieval-metadata', 'unclassified'], role) AS INT) AS display_order FROM classified GROUP BY file_id, role",
    ),
    "related_variables": (
        _related,
        ctes("fx_inventory", "fx_collections", named=_NAMED, classified=_CLASSIFIED,
             plotted=f"""SELECT p.file_id, list_last(string_split(p.v, '/')) AS variable, regexp_replace(lower(list_last(string_split(p.v, '/'))), '[^a-z0-9]', '', 'g') AS stem, list_last(string_split(c.quality_flag_var, '/')) AS qa_sibling
               FROM (SELECT file_id, regexp_replace(name, '(_uncertainty|_precision|_std|Std)$', '') AS v FROM fx_inventory WHERE ordinal = 7) p LEFT JOIN fx_collections c ON c.key_no = p.file_id""",
             sib="""SELECT p.*, c.ordinal, c.leaf, c.role, c.norm, CASE WHEN starts_with(c.norm, p.stem) AND c.norm <> p.stem THEN substr(c.norm, length(p.stem) + 1) END AS suffix FROM plotted p JOIN classified c USING (file_id)""")
        + """SELECT file_id, variable, qa_sibling, coalesce(arg_max(leaf, ordinal) FILTER (suffix = 'uncertainty'), arg_min(leaf, ordinal) FILTER (suffix IN ('precision', 'stddev', 'std', 'error'))) AS uncertainty_sibling,
        coalesce(string_agg(leaf, ',' ORDER BY ordinal) FILTER (role = 'context' AND norm <> stem), '') AS context_siblings FROM sib GROUP BY file_id, variable, qa_sibling""",
    ),
    "rank_variables": (
        lambda s, d: I.rank_variables(_requested(s, d)).withColumn("valid_fraction", F.round("valid_fraction", 6)),
        ctes("fx_inventory", sc=_SCORED, sc2=_SC2, cand=_CAND) + "SELECT file_id, rank, name, decile, score, round(frac, 6) AS valid_fraction FROM cand",
    ),
    "resolve_variable": (
        lambda s, d: I.resolve_variable(_requested(s, d)),
        ctes("fx_inventory", sc=_SCORED, sc2=_SC2, cand=_CAND, res=_RES, res2=_RES2) + """SELECT file_id,
        CASE WHEN asked_name IS NOT NULL THEN asked_name WHEN top.strong OR n = 1 THEN top.name END AS variable,
        CASE WHEN asked_name IS NOT NULL OR coalesce(top.strong, false) THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS resolution_confidence,
        CASE WHEN asked_name IS NULL AND coalesce(top.strong, false) AND serious >= 2 THEN 'high' ELSE 'low' END AS scientific_ambiguity, excluded_empty,
        CASE WHEN asked_name IS NOT NULL THEN NULL
             WHEN top.strong AND serious >= 2 AND alts IS NOT NULL THEN concat(top.label, ' ranks first among the variables with data; the file could as well be about ', alts)
             WHEN (top.strong AND serious >= 2) OR (n = 1 AND NOT top.strong) THEN concat(top.label, ' ranks first among the variables with data') END AS disclosure FROM res2""",
    ),
    "excluded_empty": (
        lambda s, d: I.excluded_empty(_requested(s, d)),
        ctes("fx_inventory", sc=_SCORED, sc2=_SC2) + "SELECT file_id, count(*) FILTER (NOT plumbing AND NOT hit AND frac <= 0) AS excluded_empty FROM sc2 GROUP BY file_id",
    ),
    "load_collections": (
        lambda s, d: I.registry_failures(fixture(s, d, "fx_collections")),
        ctes("fx_collections") + """SELECT registry_key, failures FROM (SELECT registry_key, concat_ws('; ', CASE WHEN units = '' THEN 'units is required' END, CASE WHEN fill_value IS NULL THEN 'fill_value is required' END,
        CASE WHEN valid_min IS NULL THEN 'valid_min is required' END, CASE WHEN valid_max IS NULL THEN 'valid_max is required' END, CASE WHEN valid_min > valid_max THEN 'valid_min must be <= valid_max' END) AS failures FROM fx_collections) WHERE failures <> ''""",
    ),
    "variable_read": (
        _variable_read,
        ctes("fx_cells", p="""SELECT CAST(year(ts) AS INT) AS file_id, ts, i, j, lat, CASE CAST(year(ts) AS INT) % 3 WHEN 0 THEN raw_value WHEN 1 THEN value_uncertainty ELSE raw_value * 2 END AS raw FROM fx_cells""",
             m="SELECT *, CASE WHEN raw <> -999 AND raw >= 0.5 THEN raw END AS value FROM p",
             w="SELECT file_id, ts, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY file_id, date_trunc('month', ts)) AS w FROM (SELECT DISTINCT file_id, ts FROM m WHERE value IS NOT NULL)",
             f="SELECT file_id, i, j, lat, sum(value * w) / sum(w) AS v FROM m JOIN w USING (file_id, ts) WHERE value IS NOT NULL GROUP BY ALL")
        + """SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'product/vertical_column_troposphere' WHEN 1 THEN 'column_amount_o3' ELSE 'Terra_darktarget/Mean' END AS variable, 'high' AS resolution_confidence, CAST(NULL AS VARCHAR) AS disclosure,
        count(*) AS count, CAST(printf('%.6e', sum(v * greatest(cos(radians(lat)), 0)) / sum(greatest(cos(radians(lat)), 0))) AS DOUBLE) AS mean, CAST(printf('%.6e', max(v)) AS DOUBLE) AS max FROM f GROUP BY file_id""",
    ),
    "registry_problems": (
        _registry_file,
        ctes("fx_collections", e="""SELECT key_no % 2 = 0 AS twice, key_no, registry_key, concat('C', key_no) AS alias, key_no % 97 = 5 AS torn, key_no % 89 = 7 AS wordy, cadence, units, fill_value, valid_min, valid_max,
             key_no % 61 = 3 AS keyless, key_no % 83 = 9 AS again, key_no % 71 = 4 AS claimed FROM fx_collections""",
             f="""SELECT key_no, torn, CASE WHEN torn THEN ['the line is not a JSON object of the registry''s form'] ELSE list_sort(list_filter([
               CASE WHEN keyless THEN 'registry_key is required' END, CASE WHEN units = '' THEN 'units is required' END, CASE WHEN wordy THEN 'fill_value is not a number' WHEN fill_value IS NULL THEN 'fill_value is required' END,
               CASE WHEN valid_min IS NULL THEN 'valid_min is required' END, CASE WHEN valid_max IS NULL THEN 'valid_max is required' END, CASE WHEN valid_min > valid_max THEN 'valid_min must be <= valid_max' END,
               CASE WHEN again AND NOT keyless THEN concat('name ', registry_key, ' is claimed by 2 entries') END, CASE WHEN again AND NOT keyless AND NOT claimed THEN concat('name alias of ', registry_key, ' is claimed by 2 entries') END, CASE WHEN claimed AND NOT keyless THEN concat('name shared is claimed by ', (SELECT count(*) FROM e WHERE claimed AND NOT keyless AND NOT torn) + (SELECT count(*) FROM e WHERE claimed AND again AND NOT keyless AND NOT torn), ' entries') END],
               lambda x: x IS NOT NULL)) END AS faults, again FROM e""")
        + """SELECT failures, count(*) AS n FROM (SELECT array_to_string(faults, '; ') AS failures FROM f UNION ALL SELECT array_to_string(faults, '; ') FROM f WHERE again) WHERE failures <> '' GROUP BY failures""",
    ),
    "registry_qa_audit": (
        lambda s, d: I.registry_qa_audit(fixture(s, d, "fx_collections"), _flagless(s, d)),
        ctes("fx_collections") + """SELECT registry_key, CASE WHEN quality_flag_var IS NULL AND key_no % 3 <> 0 THEN 'unaccounted' ELSE 'contradiction' END AS status FROM fx_collections
        WHERE (quality_flag_var IS NULL) = (key_no % 3 <> 0)""",
    ),
}

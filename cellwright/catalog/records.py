"""Registered queries: scalars, lineage, audits, logs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.catalog._common import r6
from cellwright.catalog.fixtures import fixture
from cellwright.functions import scalars as A
from cellwright.operators import records as R

PHRASES = (
    "find the nearest monitor;plot NO2 over Texas;compare ground and satellite;AQI today;TEMPO and the daily summary;hello;"
    "air quality index;gridded field;confirm the exceedance from a satellite;site details;where is a station;PM2.5 levels;render HCHO"
).split(";")
_N = len(PHRASES)


def _messages(s, d):
    """Every turn's whole text, followed by a phrase chosen by its place."""
    k = ((F.col("conv_id") + F.col("turn")) % _N + 1).cast("int")
    return fixture(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(p) for p in PHRASES]), k)).alias("text"))


def _re(patterns) -> str:
    return "(?is)" + "|".join(patterns)


_MSG = f"SELECT conv_id, turn, concat(text, ' ', ({PHRASES!r})[CAST((conv_id + turn) % {_N} + 1 AS INT)]) AS text FROM conversations"


def _turns(s, d):
    """Some user turns speak as the assistant, so that runs occur; every fifth text is empty."""
    role = F.when((F.col("role") != "user") | ((F.col("conv_id") + F.col("turn")) % 3 == 0), "assistant").otherwise("user")
    text = F.when((F.col("conv_id") * 3 + F.col("turn")) % 5 == 0, "").otherwise(F.col("text"))
    return fixture(s, d, "conversations").select("conv_id", "turn", role.alias("role"), text.alias("text"))


_TURNS = """SELECT conv_id, turn, CASE WHEN role <> 'user' OR (conv_id + turn) % 3 = 0 THEN 'assistant' ELSE 'user' END AS role, CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN '' ELSE text END AS text FROM conversations"""


def _walks(s, d):
    """One walk per order: its customer's dataset two steps up, an area one step up."""
    o = fixture(s, d, "orders")
    node = lambda h, depth: F.struct(h.alias("handle"), F.lit(depth).alias("depth"))
    c = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("walk_no"), F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("handle"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("cube_"), (F.col("o_orderkey") % 4000).cast("string"))).alias("resolved_handle"),
        F.array(node(F.concat(F.lit("aoi_"), (c % 50).cast("string")), 1), node(F.concat(F.lit("dataset_"), c.cast("string")), 2)).alias("ancestors"),
        F.array(F.concat(F.lit("ready:"), F.col("o_orderstatus")), F.lit("submitted")).alias("events"),
    )


_WALKS = """SELECT handle, split_part(handle, '_', 1) AS kind, depth, events, row_number() OVER (PARTITION BY handle ORDER BY w, part, place) AS rn FROM (
  SELECT concat('dataset_', o_custkey) AS handle, 2 AS depth, NULL AS events, o_orderkey AS w, 0 AS part, -2 AS place FROM orders
  UNION ALL SELECT concat('aoi_', o_custkey % 50), 1, NULL, o_orderkey, 0, -1 FROM orders
  UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('cube_', o_orderkey % 4000) ELSE concat('job_', o_orderkey) END, NULL, concat('submitted,ready:', o_orderstatus), o_orderkey, 1, 0 FROM orders)"""


def _citations(s, d):
    return fixture(s, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("dataset_"), F.col("c_custkey").cast("string")).alias("handle"), F.concat(F.lit("10.5067/"), "c_name").alias("doi"))


def _scopes(s, d):
    o = fixture(s, d, "orders")
    n = F.col("o_orderkey") % 6
    day = F.to_date("o_orderdate").cast("string")
    later = F.date_add(F.to_date("o_orderdate"), 3).cast("string")
    return o.select(
        "o_orderkey", F.when(n == 0, day).when(n == 5, None).otherwise(F.concat(day, F.lit("T00:00:00/"), F.when(n == 1, day).otherwise(later), F.lit("T23:59:59"))).alias("time_range"),
        day.alias("start_date"), F.when(n < 2, day).when(n == 2, later).otherwise(F.date_add(F.to_date("o_orderdate"), 9).cast("string")).alias("end_date"),
        F.when(n == 3, "Texas").when(n == 4, " new   Jersey, NJ").otherwise("California").alias("location"),
        F.when(n == 4, "New Jersey, United States").when(n == 1, "").otherwise("California, United States").alias("region_name"),
        F.when(n == 3, "monthly").otherwise("unknown").alias("cadence"),
    )


_SCOPES = """SELECT *, CASE WHEN n IN (0, 1) THEN d WHEN n = 5 THEN NULL ELSE l3 END AS at, CASE WHEN n < 2 THEN d WHEN n = 2 THEN l3 ELSE l9 END AS dt FROM
  (SELECT o_orderkey, o_orderkey % 6 AS n, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) AS l3, CAST(CAST(o_orderdate AS DATE) + 9 AS VARCHAR) AS l9 FROM orders)"""


def _granules(s, d):
    return fixture(s, d, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("granule"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 1000).alias("size_mb"))


_GRANULES = "SELECT concat(o_orderpriority, '/', o_orderstatus) AS dataset, o_orderkey AS granule, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 1000 END AS size_mb FROM orders"


def _estimates(s, d):
    price = F.floor(F.col("o_totalprice") * 4000).cast("long")
    return fixture(s, d, "orders").select("o_custkey", F.when(F.col("o_custkey") % 6 > 0, price).alias("bytes"), (F.col("o_custkey") % 4 == 0).alias("confirmed"))


def _log(s, d):
    phases = F.array(*[F.lit(p) for p in R.PHASES[:5]])
    return fixture(s, d, "events").select(F.element_at(phases, (F.col("user_id") % 5 + 1).cast("int")).alias("phase"), (F.col("value") / 997).alias("duration_seconds"))


def _scalars(s, d):
    p = fixture(s, d, "supplier")
    lat1, lon1 = (F.col("s_suppkey") % 170 - 85).cast("double"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double")
    text = F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 4 == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(".5")))
    return p.select(
        "s_suppkey", F.round(A.cos_weight(lat1), 6).alias("weight"), F.round(A.haversine_miles(lat1, lon1, F.lit(40.0), F.lit(-74.0)), 3).alias("miles"),
        A.float_or_none(text).alias("number"), A.sig7(F.col("s_acctbal") / 997).alias("sig"), A.normalized("s_name").alias("norm"),
        A.coverage_decile((F.col("s_suppkey") % 12).cast("double") / 11).alias("decile"), A.half_cell(F.lit(10.0), F.lit(10.0) + F.col("s_suppkey") % 3, F.col("s_suppkey") % 3 + 1).alias("half"),
    )


QUERIES = {
    "scalar_functions": (
        _scalars,
        """SELECT s_suppkey, round(greatest(cos(radians(a)), 0), 6) AS weight, round(2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(40 - a) / 2), 2) + cos(radians(a)) * cos(radians(40)) * pow(sin(radians(-74 - b) / 2), 2)))), 3) AS miles,
        CASE WHEN s_suppkey % 4 > 1 THEN s_suppkey + CAST(0.5 AS DOUBLE) END AS number, CAST(printf('%.6e', s_acctbal / 997) AS DOUBLE) AS sig, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS norm,
        CAST(least(10, floor(CAST(s_suppkey % 12 AS DOUBLE) / 11 * 10)) AS INT) AS decile, CASE WHEN s_suppkey % 3 > 0 THEN CAST(0.5 AS DOUBLE) * (s_suppkey % 3) / (s_suppkey % 3) ELSE 0.5 END AS half
        FROM (SELECT *, CAST(s_suppkey % 170 - 85 AS DOUBLE) AS a, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS b FROM supplier)""",
    ),
    "merge_lineage": (
        lambda s, d: R.merge_lineage(_walks(s, d)).select("handle", "kind", F.col("depth").cast("double").alias("depth"), F.array_join("events", ",").alias("events")),
        f"WITH w AS ({_WALKS}) SELECT handle, kind, CAST(depth AS DOUBLE) AS depth, events FROM w WHERE rn = 1",
    ),
    "distinct_citations": (
        lambda s, d: R.distinct_citations(R.merge_lineage(_walks(s, d)), _citations(s, d)),
        "SELECT concat('dataset_', c_custkey) AS handle, concat('10.5067/', c_name) AS doi FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "scope_audit": (
        lambda s, d: R.scope_audit(_scopes(s, d)).select("o_orderkey", "time_differs", "place_differs", "note"),
        f"""WITH s AS ({_SCOPES}), f AS (SELECT *, at IS NOT NULL AND at <> dt AS td, n = 3 AS pd FROM s) SELECT o_orderkey, td AS time_differs, pd AS place_differs,
        CASE WHEN td OR pd THEN concat_ws('; ', CASE WHEN td THEN concat(CASE WHEN at = d THEN d ELSE concat(d, ' to ', at) END, ' was wanted, ', CASE WHEN dt = d THEN d ELSE concat(d, ' to ', dt) END, ' is given', CASE WHEN n = 3 THEN ', from monthly data' ELSE '' END) END,
        CASE WHEN pd THEN 'Texas was wanted, California, United States is given' END) END AS note FROM f""".replace("at IS NOT NULL AND at <> dt", "\"at\" IS NOT NULL AND \"at\" <> dt").replace("WHEN at = d THEN d ELSE concat(d, ' to ', at)", "WHEN \"at\" = d THEN d ELSE concat(d, ' to ', \"at\")").replace("l3 END AS at,", "l3 END AS \"at\","),
    ),
    "granule_totals": (
        lambda s, d: r6(R.granule_totals(_granules(s, d), ["dataset"]), "total_size_mb"),
        f"SELECT dataset, count(*) AS count, round(sum(coalesce(size_mb, 0)), 6) AS total_size_mb, count(*) FILTER (size_mb IS NULL) AS unsized FROM ({_GRANULES}) GROUP BY dataset",
    ),
    "granule_listing": (
        lambda s, d: r6(R.granule_listing(_granules(s, d), ["dataset"], "granule", 25), "size_mb"),
        f"""SELECT dataset, granule, round(size_mb, 6) AS size_mb, CAST(rank AS INT) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY granule) AS rank FROM ({_GRANULES})) WHERE rank <= 25""",
    ),
    "size_gate": (
        lambda s, d: R.size_gate(_estimates(s, d), ["o_custkey"]).withColumn("estimated_bytes", F.col("estimated_bytes").cast("double")),
        """SELECT o_custkey, CAST(b AS DOUBLE) AS estimated_bytes, CASE WHEN b > 10737418240 THEN 'refused' WHEN (b IS NULL OR b > 2147483648) AND o_custkey % 4 <> 0 THEN 'needs_confirmation' ELSE 'submitted' END AS status
        FROM (SELECT o_custkey, sum(CASE WHEN o_custkey % 6 > 0 THEN CAST(floor(o_totalprice * 4000) AS BIGINT) END) AS b FROM orders GROUP BY o_custkey)""",
    ),
    "phase_rollup": (
        lambda s, d: r6(R.phase_rollup(_log(s, d)), "total_seconds", "p50", "p95"),
        f"""WITH l AS (SELECT ({R.PHASES[:5]!r})[CAST(user_id % 5 + 1 AS INT)] AS phase, value / 997 AS s FROM events)
        SELECT p.phase, count(l.s) AS count, round(coalesce(sum(l.s), 0), 6) AS total_seconds, round(quantile_cont(l.s, 0.5), 6) AS p50, round(quantile_cont(l.s, 0.95), 6) AS p95
        FROM (SELECT unnest({R.PHASES!r}) AS phase) p LEFT JOIN l USING (phase) GROUP BY p.phase""",
    ),
    "route_messages": (
        lambda s, d: R.route_messages(_messages(s, d)),
        f"""WITH m AS ({_MSG}), f AS (SELECT regexp_matches(text, '{_re(R.GROUND_PATTERNS)}') AS g, regexp_matches(text, '{_re(R.SATELLITE_PATTERNS)}') AS s, regexp_matches(text, '{_re(R.CROSS_PATTERNS)}') AS x FROM m)
        SELECT CASE WHEN x OR (g AND s) THEN 'BOTH' WHEN g THEN 'GROUND' WHEN s THEN 'SATELLITE' ELSE 'LLM' END AS label, count(*) AS n FROM f GROUP BY 1""",
    ),
    "merge_turns": (
        lambda s, d: R.merge_turns(_turns(s, d), chunk=2),
        f"""WITH t AS ({_TURNS}), b AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 1 END AS st FROM t),
        r AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS message FROM b)
        SELECT conv_id, CAST(message AS BIGINT) AS message, role, min(turn) AS first_turn, count(*) AS merged, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text FROM r GROUP BY conv_id, message, role""",
    ),
}

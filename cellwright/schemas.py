"""Fixed schemas of the core tables."""

from __future__ import annotations

from pyspark.sql import types as T

CELLS = T.StructType([
    T.StructField("collection", T.StringType(), False),
    T.StructField("granule_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("i", T.IntegerType(), False),
    T.StructField("j", T.IntegerType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("level", T.DoubleType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("qa_flag", T.IntegerType(), True),
])

COLLECTIONS = T.StructType([
    T.StructField("registry_key", T.StringType(), False),
    T.StructField("collection_id", T.StringType(), True),
    T.StructField("short_name", T.StringType(), True),
    T.StructField("version", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("cadence", T.StringType(), True),
    T.StructField("provider", T.StringType(), True),
    T.StructField("instrument", T.StringType(), True),
    T.StructField("primary_var", T.StringType(), True),
    T.StructField("quality_flag_var", T.StringType(), True),
    T.StructField("qa_good_values", T.ArrayType(T.IntegerType()), True),
    T.StructField("qa_bad_values", T.ArrayType(T.IntegerType()), True),
    T.StructField("variables", T.ArrayType(T.StringType()), True),
    T.StructField("groups", T.ArrayType(T.StringType()), True),
    T.StructField("supports_variable_subsetting", T.BooleanType(), True),
    T.StructField("units", T.StringType(), True),
    T.StructField("fill_value", T.DoubleType(), True),
    T.StructField("valid_min", T.DoubleType(), True),
    T.StructField("valid_max", T.DoubleType(), True),
])

VARIABLES = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("group_path", T.StringType(), True),
    T.StructField("long_name", T.StringType(), True),
    T.StructField("units", T.StringType(), True),
    T.StructField("standard_name", T.StringType(), True),
    T.StructField("flag_values", T.StringType(), True),
    T.StructField("flag_meanings", T.StringType(), True),
])

REGIONS = T.StructType([
    T.StructField("region_id", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("region_type", T.StringType(), True),
    T.StructField("minx", T.DoubleType(), True),
    T.StructField("miny", T.DoubleType(), True),
    T.StructField("maxx", T.DoubleType(), True),
    T.StructField("maxy", T.DoubleType(), True),
])

REGION_EDGES = T.StructType([
    T.StructField("region_id", T.StringType(), False),
    T.StructField("x1", T.DoubleType(), False),
    T.StructField("y1", T.DoubleType(), False),
    T.StructField("x2", T.DoubleType(), False),
    T.StructField("y2", T.DoubleType(), False),
])

MONITORS = T.StructType([
    T.StructField("state_code", T.StringType(), True),
    T.StructField("county_code", T.StringType(), True),
    T.StructField("site_number", T.StringType(), True),
    T.StructField("local_site_name", T.StringType(), True),
    T.StructField("latitude", T.StringType(), True),
    T.StructField("longitude", T.StringType(), True),
])

_GROUND_BASE = [
    T.StructField("state_code", T.StringType(), True),
    T.StructField("county_code", T.StringType(), True),
    T.StructField("site_number", T.StringType(), True),
    T.StructField("local_site_name", T.StringType(), True),
    T.StructField("pollutant_standard", T.StringType(), True),
    T.StructField("units_of_measure", T.StringType(), True),
    T.StructField("sample_duration", T.StringType(), True),
    T.StructField("arithmetic_mean", T.StringType(), True),
    T.StructField("observation_count", T.StringType(), True),
    T.StructField("observation_percent", T.StringType(), True),
]

GROUND_DAILY = T.StructType(_GROUND_BASE + [
    T.StructField("date_local", T.StringType(), True),
    T.StructField("first_max_value", T.StringType(), True),
    T.StructField("first_max_hour", T.StringType(), True),
])

GROUND_PERIODIC = T.StructType(_GROUND_BASE + [
    T.StructField("year", T.IntegerType(), True),
    T.StructField("quarter", T.IntegerType(), True),
    T.StructField("minimum_value", T.StringType(), True),
    T.StructField("maximum_value", T.StringType(), True),
    T.StructField("valid_day_count", T.StringType(), True),
    T.StructField("required_day_count", T.StringType(), True),
])

GROUND_SAMPLES = T.StructType([
    T.StructField("state_code", T.StringType(), True),
    T.StructField("county_code", T.StringType(), True),
    T.StructField("site_number", T.StringType(), True),
    T.StructField("local_site_name", T.StringType(), True),
    T.StructField("date_local", T.StringType(), True),
    T.StructField("time_local", T.StringType(), True),
    T.StructField("sample_measurement", T.DoubleType(), True),
    T.StructField("units_of_measure", T.StringType(), True),
    T.StructField("sample_duration", T.StringType(), True),
    T.StructField("qualifier", T.StringType(), True),
    T.StructField("method", T.StringType(), True),
])

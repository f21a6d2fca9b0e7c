"""The registry of collections from a file: every entry read, every fault reported, or one validated table.

A registry is a JSON-lines file, one collection per line. Nothing stops at the first fault: lines that are no JSON, values that
are no numbers, missing or contradictory facts, and names that two entries claim are found together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import float_or_none
from cellwright.operators.inventory import registry_failures
from cellwright.session import settle

# --- Fixed values ---------------------------------------------------------------------------------
CADENCES = ("hourly", "daily", "monthly")
DEFAULT_CADENCE = "daily"
INFINITE = {".inf": "Infinity", "inf": "Infinity", "-.inf": "-Infinity", "-inf": "-Infinity"}
# --------------------------------------------------------------------------------------------------

_NUMBERS = ("fill_value", "valid_min", "valid_max")
_TEXTS = ("registry_key", "collection_id", "short_name", "version", "description", "cadence", "provider", "instrument", "primary_var", "quality_flag_var", "units")
_LISTS = {"qa_good_values": "array<int>", "qa_bad_values": "array<int>", "variables": "array<string>", "groups": "array<string>", "aliases": "array<string>"}
ENTRY = ", ".join([*(f"{c} string" for c in (*_TEXTS, *_NUMBERS)), *(f"{c} {k}" for c, k in _LISTS.items()), "supports_variable_subsetting boolean"])


def _number(name: str) -> Column:
    text = F.lower(F.trim(F.col(name)))
    for written, meant in INFINITE.items():
        text = F.when(text == written, meant).otherwise(text)
    return float_or_none(text)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the file: its typed columns, `unread`, the line itself where it is no JSON object of this form, and `malformed`, the numbers that are none."""
    held = spark.read.schema(f"{ENTRY}, unread string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unread").json(path)
    wrong = F.array_compact(F.array(*[F.when((F.trim(F.col(c)) != "") & _number(c).isNull(), F.lit(c)) for c in _NUMBERS]))
    typed = held.withColumns({"malformed": wrong}).withColumns({c: _number(c) for c in _NUMBERS})
    cadence = F.coalesce(F.nullif(F.trim("cadence"), F.lit("")), F.lit(DEFAULT_CADENCE))
    return typed.withColumns({"cadence": cadence, "short_name": F.coalesce("short_name", F.lit(""))})


def _claims(entries: DataFrame) -> DataFrame:
    """Names that more than one entry claims, as its key or as an alias, with the claimants' own keys."""
    names = F.array_distinct(F.concat(F.array("registry_key"), F.coalesce("aliases", F.array().cast("array<string>"))))
    claimed = entries.where("unread IS NULL AND registry_key IS NOT NULL").select("line", "registry_key", F.explode(names).alias("name"))
    # names meet whatever their case; a name has few claimants, but for a registry that repeats one line over and over
    counted = claimed.groupBy(F.upper("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return claimed.withColumn("_name", F.upper("name")).join(counted, "_name").select(
        "line", "registry_key", F.concat(F.lit("name "), "name", F.lit(" is claimed by "), F.col("_n").cast("string"), F.lit(" entries")).alias("failure"))


def registry_problems(entries: DataFrame) -> DataFrame:
    """line, registry_key and `failures`, all that is wrong with an entry, for every entry with any fault."""
    entries = settle(entries.withColumn("line", F.monotonically_increasing_id()), "entries")
    unread = entries.where("unread IS NOT NULL").select("line", "registry_key", F.lit("the line is not a JSON object of the registry's form").alias("failure"))
    sound = entries.where("unread IS NULL")
    keyless = sound.where("coalesce(trim(registry_key), '') = ''").select("line", "registry_key", F.lit("registry_key is required").alias("failure"))
    numbers = sound.select("line", "registry_key", F.explode("malformed").alias("c")).select("line", "registry_key", F.concat("c", F.lit(" is not a number")).alias("failure"))
    # a number that could not be read is reported as that, not as missing too
    known = registry_failures(sound.withColumn("registry_key", F.col("line").cast("string")), F.col("malformed"))
    own = known.join(sound.select(F.col("line"), F.col("registry_key").alias("_key")), F.col("registry_key") == F.col("line").cast("string"))
    own = own.select("line", F.col("_key").alias("registry_key"), F.explode(F.split("failures", "; ")).alias("failure"))
    every = unread.unionByName(keyless).unionByName(numbers).unionByName(own).unionByName(_claims(entries))
    return every.groupBy("line", "registry_key").agg(F.array_join(F.array_sort(F.collect_set("failure")), "; ").alias("failures"))


def load_collections(spark: SparkSession, path: str) -> DataFrame:
    """The validated registry. With any fault it is refused, and the error names every entry that has one and all of its faults."""
    entries = settle(read_entries(spark, path), "registry")
    wrong = registry_problems(entries).orderBy("line").collect()  # the faults of a file that people write
    if wrong:
        raise ValueError("the registry has faults:\n" + "\n".join(f"[{r['registry_key'] or '?'}] {r['failures']}" for r in wrong))
    return entries.drop("unread", "malformed")


def by_name(registry: DataFrame) -> DataFrame:
    """One row for each name an entry answers to, its key first and then its aliases, for joins on `name` in upper case."""
    names = F.posexplode(F.concat(F.array("registry_key"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = registry.select("*", names.alias("_at", "name")).withColumn("name", F.upper("name"))
    first = F.row_number().over(Window.partitionBy("registry_key", "name").orderBy("_at"))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first", "_at")

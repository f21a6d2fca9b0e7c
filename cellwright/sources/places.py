"""Named regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.schemas import REGIONS

# --- Fixed values: named boxes as minx, miny, maxx, maxy, and their display names -----------------
NAMED_BOXES = {
    "global": (-180, -90, 180, 90, "Global"),
    "world": (-180, -90, 180, 90, "World"),
    "earth": (-180, -90, 180, 90, "Earth"),
    "north america": (-168, 7, -52, 84, "North America"),
    "south america": (-82, -56, -34, 13, "South America"),
    "europe": (-25, 34, 45, 72, "Europe"),
    "africa": (-18, -35, 52, 38, "Africa"),
    "asia": (26, -10, 180, 78, "Asia"),
    "oceania": (110, -50, 180, 25, "Oceania"),
    "antarctica": (-180, -90, 180, -60, "Antarctica"),
    "united states": (-125, 24, -66, 50, "United States"),
    "usa": (-125, 24, -66, 50, "United States"),
    "us": (-125, 24, -66, 50, "United States"),
    "conus": (-125, 24, -66, 50, "Continental US"),
    "continental us": (-125, 24, -66, 50, "Continental US"),
    "contiguous us": (-125, 24, -66, 50, "Continental US"),
    "lower 48": (-125, 24, -66, 50, "Continental US"),
    "northeast us": (-80, 37, -66, 48, "Northeast US"),
    "southeast us": (-92, 24, -75, 37, "Southeast US"),
    "midwest us": (-104, 36, -80, 50, "Midwest US"),
    "southwest us": (-125, 31, -102, 42, "Southwest US"),
    "northwest us": (-125, 42, -110, 50, "Northwest US"),
    "great plains": (-105, 36, -96, 50, "Great Plains"),
    "great lakes": (-92, 41, -76, 48, "Great Lakes"),
    "western europe": (-10, 35, 20, 60, "Western Europe"),
    "eastern europe": (14, 44, 33, 55, "Eastern Europe"),
    "northern europe": (-25, 54, 32, 72, "Northern Europe"),
    "southern europe": (-10, 35, 30, 46, "Southern Europe"),
    "scandinavia": (4, 55, 32, 72, "Scandinavia"),
    "east asia": (100, 20, 145, 54, "East Asia"),
    "southeast asia": (95, -10, 141, 28, "Southeast Asia"),
    "south asia": (61, 6, 97, 37, "South Asia"),
    "central asia": (46, 36, 87, 56, "Central Asia"),
    "middle east": (26, 12, 63, 42, "Middle East"),
    "north africa": (-18, 15, 38, 38, "North Africa"),
    "sub-saharan africa": (-18, -35, 52, 15, "Sub-Saharan Africa"),
    "west africa": (-18, 4, 16, 20, "West Africa"),
    "east africa": (29, -12, 52, 16, "East Africa"),
    "southern africa": (11, -35, 40, -15, "Southern Africa"),
}
POLYGON_NAMES = [
    "united states", "usa", "us", "conus", "continental us", "contiguous us", "lower 48",
    "north america", "south america", "europe", "africa", "asia", "oceania", "antarctica",
]
#: Names that share the polygon of another.
SAME_POLYGON = {
    "usa": "united states",
    "us": "united states",
    "continental us": "conus",
    "contiguous us": "conus",
    "lower 48": "conus",
}
# --------------------------------------------------------------------------------------------------


def load_regions(spark: SparkSession, polygons: DataFrame | None = None) -> DataFrame:
    """Named boxes; a name with a polygon in `polygons` (an edge table) takes that polygon's extent.

    `polygon_id` says which one: aliases share the polygon of the name they stand for.
    """
    rows = [(k, v[4], "bounding_box", *map(float, v[:4])) for k, v in NAMED_BOXES.items()]
    regions = spark.createDataFrame(rows, REGIONS)
    if polygons is None:
        return regions
    extent = polygons.where(F.col("region_id").isin(POLYGON_NAMES)).groupBy("region_id").agg(
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    ).select("region_id", F.struct(F.col("region_id").alias("polygon_id"), "minx", "miny", "maxx", "maxy").alias("_own"))
    shared = F.coalesce(*[F.when(F.col("region_id") == alias, name) for alias, name in SAME_POLYGON.items()])
    # A name's own polygon comes before the one it shares.
    joined = regions.join(extent, "region_id", "left").withColumn("_alias", shared).join(
        extent.select(F.col("region_id").alias("_alias"), F.col("_own").alias("_shared")), "_alias", "left"
    ).withColumn("_e", F.coalesce("_own", "_shared"))
    return joined.select(
        "region_id", "name", F.col("_e.polygon_id").alias("polygon_id"),
        F.when(F.col("_e").isNotNull(), "polygon").otherwise(F.col("region_type")).alias("region_type"),
        *[F.coalesce(f"_e.{c}", c).alias(c) for c in ("minx", "miny", "maxx", "maxy")],
    )


def place_name(name: Column | str) -> Column:
    """Lower case, single spaces, no leading article."""
    text = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.regexp_replace(text, "^the ", "")


def resolve_places(places: DataFrame, regions: DataFrame, name: str = "place") -> DataFrame:
    """Rows of `places` with the region their name stands for; unknown names stay without one.

    The region table has a few dozen fixed rows, so it is sent to every task.
    """
    return places.withColumn("region_id", place_name(name)).join(F.broadcast(regions), "region_id", "left")

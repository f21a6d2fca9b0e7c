"""Axes, levels and regions: narrowing cells to where and what is analyzed.

Regions are closed: an edge counts as inside. Narrowing always precedes masking, so that counters
describe the analyzed region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import half_cell
from cellwright.operators import order_stats
from cellwright.operators.cover import bounded, cover, covered, touched
from cellwright.schemas import REGION_EDGES
from cellwright.session import settle
from cellwright.sources.survey import extents, highest, lowest, survey

STEP_TOLERANCE = 1e-3

# --- Fixed values ---------------------------------------------------------------------------------
MIN_BOX_HALF = 0.25
POINT_HALF = 0.1
BOX_LADDER = [0.0, 0.5, 1.5, 3.0, 5.0]
METRES = ["m", "metre", "metres", "meter", "meters"]
# --------------------------------------------------------------------------------------------------

Box = tuple[float, float, float, float]  # minx, miny, maxx, maxy


def in_box(box: Box, lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    return lat.between(float(box[1]), float(box[3])) & lon.between(float(box[0]), float(box[2]))


def crop_bounds(cells: DataFrame, box: Box) -> DataFrame:
    """Cells whose centers lie in the box. Literal bounds reach the Parquet scan."""
    return cells.where(in_box(box))


def point_buffer(lon: float, lat: float) -> Box:
    """The small box that stands for a place known only as a point."""
    return (lon - POINT_HALF, lat - POINT_HALF, lon + POINT_HALF, lat + POINT_HALF)


def normalize_longitude(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bring 0..360 longitudes to -180..180 and renumber `j` by the new order.

    Only the distinct axis values are windowed: one short row list per collection. The new axis is written, so that
    Spark knows how small it is and does not shuffle the cells to meet it. Cells without a longitude stay as they are.
    """
    keys = list(keys)
    axis = cells.select(*keys, "lon").where(F.col("lon").isNotNull()).distinct()
    whole = Window.partitionBy(*keys)
    wraps = (F.min("lon").over(whole) >= 0) & (F.max("lon").over(whole) > 180)
    axis = axis.withColumn("_wraps", wraps).withColumn(
        "_lon", F.when(F.col("_wraps"), F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).otherwise(F.col("lon"))
    )
    axis = settle(axis.withColumn("_j", F.dense_rank().over(whole.orderBy("_lon")) - 1), "longitudes")
    return (
        cells.join(axis, [*keys, "lon"], "left")
        .withColumns({
            "j": F.when(F.col("_wraps"), F.col("_j")).otherwise(F.col("j")).cast("int"),
            "lon": F.col("_lon"),
        })
        .drop("_wraps", "_lon", "_j")
    )


def grid_axes(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extent and cell count of both axes, one row per key. Partial aggregation only."""
    return cells.groupBy(*keys).agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.count_distinct("lat").alias("n_lat"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.count_distinct("lon").alias("n_lon"),
    )


def pixel_edges(axes: DataFrame) -> DataFrame:
    """Pixel-edge bounds from pixel-center extents."""
    hx, hy = half_cell("lon_min", "lon_max", "n_lon"), half_cell("lat_min", "lat_max", "n_lat")
    return axes.withColumns({
        "edge_west": F.col("lon_min") - hx, "edge_east": F.col("lon_max") + hx,
        "edge_south": F.col("lat_min") - hy, "edge_north": F.col("lat_max") + hy,
    })


def _positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, position and the least and greatest coordinate there, both axes from one pass."""
    rows = cells.groupingSets([[*keys, "i"], [*keys, "j"]], *keys, "i", "j").agg(
        F.grouping("i").alias("_j"), F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"),
        F.bool_or(F.col("lat").isNull()).alias("lat_gone"), F.bool_or(F.col("lon").isNull()).alias("lon_gone"))
    by = lambda c: F.when(F.col("_j") == 0, F.col(f"lat_{c}")).otherwise(F.col(f"lon_{c}")).alias(c)
    return rows.select(*keys, F.when(F.col("_j") == 0, "lat").otherwise("lon").alias("axis"), F.coalesce("i", "j").alias("position"), by("lo"), by("hi"), by("gone"))


def grid_kind(cells: DataFrame, keys: Sequence[str], described: DataFrame | None = None) -> DataFrame:
    """rectilinear / irregular / curvilinear / projected / none, one row per key.

    A grid is curvilinear when one array position carries several coordinates on an axis, and irregular when a step between
    neighbours departs from the median step. A step joins two positions by number, so an axis is never gathered: what a grid
    needs are its least, greatest and median steps. A grid without latitudes and longitudes is projected when
    `described`, one row per key, names its `crs` or gives `x_units` and `y_units` in metres.
    """
    keys = list(keys)
    places = settle(_positions(cells, keys), "positions")  # the one pass over the cells
    facts = places.groupBy(*keys).agg(F.bool_or(F.col("lo") != F.col("hi")).alias("_curved"), F.bool_or("gone").alias("_none"))
    here = places.select(*keys, "axis", "position", F.col("lo").alias("_here"))
    after = places.select(*keys, "axis", (F.col("position") - 1).alias("position"), F.col("lo").alias("_after"))
    steps = here.join(after, [*keys, "axis", "position"]).withColumn("_step", F.col("_after") - F.col("_here"))
    spread = steps.groupBy(*keys, "axis").agg(F.min("_step").alias("_least"), F.max("_step").alias("_most"), F.count("_step").alias("_steps"))
    middle = order_stats.quantiles(steps, [*keys, "axis"], "_step", {"_median": 0.5}).drop("n")
    worst = F.greatest(F.col("_most") - F.col("_median"), F.col("_median") - F.col("_least"))
    even = (F.col("_steps") < 2) | (F.col("_median") == 0) | (worst <= F.lit(STEP_TOLERANCE) * F.abs("_median"))
    regular = spread.join(middle, [*keys, "axis"]).groupBy(*keys).agg(F.bool_and(even).alias("_regular"))
    kinds = facts.join(regular, keys, "left")
    projected = F.lit(False)
    if described is not None:
        metres = lambda c: F.coalesce(F.lower(F.trim(c)).isin(METRES), F.lit(False))
        marked = described.select(*keys, (F.coalesce(F.trim("crs") != "", F.lit(False)) | (metres("x_units") & metres("y_units"))).alias("_projected"))
        kinds, projected = kinds.join(marked, keys, "left"), F.coalesce("_projected", F.lit(False))
    kind = (
        F.when(F.col("_none") & projected, "projected").when(F.col("_none"), "none").when(F.col("_curved"), "curvilinear")
        .when(F.coalesce("_regular", F.lit(True)), "rectilinear").otherwise("irregular")
    )
    return kinds.select(*keys, kind.alias("grid_kind"))


def grid_refusals(kinds: DataFrame) -> DataFrame:
    """Grids that boxes, polygons and maps would misplace, with the reason: to be told before anything is masked."""
    reason = (
        F.when(F.col("grid_kind") == "irregular", "steps of an axis differ, so cells have no common size")
        .when(F.col("grid_kind") == "curvilinear", "rows and columns have no latitude and longitude of their own")
        .when(F.col("grid_kind") == "projected", "positions are in metres of a projection, not degrees")
    )
    return kinds.withColumn("reason", reason).where(F.col("reason").isNotNull())


def supported_cells(cells: DataFrame, kinds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the grids that are not refused."""
    refused = settle(grid_refusals(kinds).select(*keys), "refused")
    return cells.join(refused, list(keys), "left_anti")


# --- Polygons -------------------------------------------------------------------------------------

def polygon_edges(spark, polygons: dict[str, Sequence[Sequence[tuple[float, float]]]]) -> DataFrame:
    """Edge table of polygons given as rings of (x, y) points; several rings make holes and parts."""
    rows = []
    for region_id, rings in polygons.items():
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, list(ring[1:]) + [ring[0]]):
                rows.append((region_id, float(x1), float(y1), float(x2), float(y2)))
    return spark.createDataFrame(rows, REGION_EDGES)


def region_mask_polygon(cells: DataFrame, edges: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Cells whose centers lie in a polygon, with its `region_id`.

    Places are decided once, by a hierarchical cover of the grid (`operators.cover`); a cell tests one bit.
    `grid` is the grid's survey, kept or made here in one pass over the cells.
    """
    grid = survey(cells) if grid is None else grid
    return covered(bounded(cells, edges), cover(grid, edges))


def polygon_panels(
    cells: DataFrame, polygons: dict[str, Sequence[Sequence[tuple[float, float]]]], value: str = "raw_value", grid: DataFrame | None = None
) -> DataFrame:
    """One panel per polygon: the grid of its bounding box, with values outside the polygon missing.

    For maps, whose shape and valid share refer to the whole rectangle. The boxes are literals and
    prune the scan; every polygon keeps its own rows.
    """
    boxes = {}
    for region_id, rings in polygons.items():
        xs, ys = [x for ring in rings for x, _ in ring], [y for ring in rings for _, y in ring]
        boxes[region_id] = (min(xs), min(ys), max(xs), max(ys))
    found = cover(survey(cells) if grid is None else grid, polygon_edges(cells.sparkSession, polygons))
    rows = covered(with_regions(cells, boxes), found, "left", ("region_id",))
    return rows.withColumn(value, F.when(F.col("_inside"), F.col(value))).drop("_inside")


def region_mask_boundary(cells: DataFrame, edges: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Cells of each polygon; a polygon that holds no cell center keeps every cell it touches.

    `region_type` says which rule applied. `grid` is the grid's survey, kept or made here in one pass over the cells.
    """
    grid = survey(cells) if grid is None else grid
    found = cover(grid, edges)
    inside = covered(bounded(cells, edges), found).withColumn("region_type", F.lit("polygon"))
    small = edges.join(found.select("region_id").distinct(), "region_id", "left_anti")
    places = settle(touched(grid, small), "touched")
    rescued = bounded_places(cells, places).join(places, ["i", "j"]).withColumn("region_type", F.lit("boundary_cells"))
    return inside.unionByName(rescued.select(inside.columns))


def bounded_places(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Cells within the rows and columns of some places; the bounds reach the reader."""
    for c in ("i", "j"):
        cells = cells.where((F.col(c) >= lowest(places, c)) & (F.col(c) <= highest(places, c)))
    return cells


def region_mask_box(cells: DataFrame, box: Box, region_id: str, grid: DataFrame | None = None) -> DataFrame:
    """Cells of a box; a box that holds no cell center keeps every cell it overlaps.

    Which rule applies, and with it the bounds, follows from the grid's survey when the query runs; the bounds reach the
    Parquet reader, and nothing is decided on the driver.
    """
    grid = survey(cells) if grid is None else grid
    held = [F.bool_or((F.col("kind") == k) & F.col(f"{k}_lo").between(float(lo), float(hi))) for k, lo, hi in (("lat", box[1], box[3]), ("lon", box[0], box[2]))]
    any_center = grid.groupBy().agg(F.coalesce(held[0] & held[1], F.lit(False)).alias("any_center"))
    size = extents(grid).select(half_cell("lon_min", "lon_max", "n_lon").alias("hx"), half_cell("lat_min", "lat_max", "n_lat").alias("hy"))
    widened = size.withColumn("any_center", any_center.scalar())
    x, y = (F.when(F.col("any_center"), 0.0).otherwise(F.col(h)) for h in ("hx", "hy"))
    bounds = widened.select(
        (F.lit(float(box[0])) - x).alias("west"), (F.lit(float(box[1])) - y).alias("south"), (F.lit(float(box[2])) + x).alias("east"), (F.lit(float(box[3])) + y).alias("north"),
        F.when(F.col("any_center"), "bounding_box").otherwise("boundary_cells").alias("region_type"))
    bounds = settle(bounds, "bounds")
    kept = cells
    for c, lo, hi in (("lat", "south", "north"), ("lon", "west", "east")):
        kept = kept.where((F.col(c) >= lowest(bounds, lo)) & (F.col(c) <= lowest(bounds, hi)))
    return kept.withColumns({"region_id": F.lit(region_id), "region_type": lowest(bounds, "region_type")})


def with_regions(cells: DataFrame, boxes: dict[str, Box]) -> DataFrame:
    """One row per (cell, box that holds it): all boxes in one pass over the cells.

    The boxes are literals, so the scan is pruned to their union.
    """
    anywhere = F.lit(False)
    held = []
    for region_id, box in boxes.items():
        anywhere = anywhere | in_box(box)
        held.append(F.when(in_box(box), F.lit(region_id)))
    return cells.where(anywhere).withColumn("region_id", F.explode(F.array_compact(F.array(*held))))


# --- Levels ---------------------------------------------------------------------------------------

def level_choice(cells: DataFrame, requested: float) -> DataFrame:
    """The level nearest to the request, refused outside the coordinate's own range."""
    x = F.lit(float(requested))
    picked = cells.groupBy().agg(
        F.min("level").alias("level_min"), F.max("level").alias("level_max"),
        F.min(F.when(F.col("level").isNotNull(), F.struct(F.abs(F.col("level") - x).alias("d"), (-F.col("level")).alias("m")))).alias("_p"),
    )
    ok = x.between(F.col("level_min"), F.col("level_max"))
    return picked.select(
        x.alias("requested"), "level_min", "level_max",
        F.when(ok, -F.col("_p.m")).alias("level"),
        F.when(ok, "selected").otherwise("dimension_choice_required").alias("status"),
    )


def select_level(cells: DataFrame, requested: float) -> DataFrame:
    """Cells of the nearest level; none when the request is out of range (see `level_choice`)."""
    return cells.where(F.col("level") == level_choice(cells, requested).select("level").scalar())


def select_level_position(cells: DataFrame, index: float) -> DataFrame:
    """Cells at a 0-based position among the levels; none for a fractional or out-of-range index."""
    levels = cells.select("level").distinct()
    ranked = levels.withColumn("_pos", F.dense_rank().over(Window.orderBy("level")) - 1)
    wanted = ranked.where(F.col("_pos") == F.lit(float(index))).groupBy().agg(F.max("level").alias("level"))
    return cells.where(F.col("level") == wanted.scalar())


def require_choice(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether a level must be chosen first, with the levels to choose from."""
    return cells.groupBy(*keys).agg(
        F.count_distinct("level").alias("n_levels"),
        F.array_join(F.array_sort(F.collect_set("level")).cast("array<string>"), ", ").alias("choices"),
    ).withColumn("refused", F.col("n_levels") > 1)


# --- Boxes as data --------------------------------------------------------------------------------

def min_bbox(boxes: DataFrame) -> DataFrame:
    """Widen boxes (south, north, west, east) to the smallest half width around their center."""
    out = {}
    for a, b in (("south", "north"), ("west", "east")):
        mid = (F.col(a) + F.col(b)) / 2
        half = F.greatest((F.col(b) - F.col(a)) / 2, F.lit(MIN_BOX_HALF))
        out[a], out[b] = mid - half, mid + half
    return boxes.withColumns(out)


def expand_bbox(boxes: DataFrame) -> DataFrame:
    """Every step of the search ladder, each from the original box."""
    ladder = F.array(*[F.lit(step) for step in BOX_LADDER])
    return boxes.select("*", F.posexplode(ladder).alias("step", "degrees")).withColumns({
        "south": F.col("south") - F.col("degrees"), "north": F.col("north") + F.col("degrees"),
        "west": F.col("west") - F.col("degrees"), "east": F.col("east") + F.col("degrees"),
    })

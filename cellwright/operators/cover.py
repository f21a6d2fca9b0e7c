"""Polygons on a grid: a hierarchical cover by blocks of positions, decided once for all timesteps.

Each row of the grid meets the edges that cross its latitude; what lies between two crossings is inside. The columns of a row are
decided in tiles of 256, then in blocks of 16: one without a crossing is inside or outside as a whole, and only the
places of the others are tested one by one. The result is one row per polygon and block of 16 by 16 places,
with a bit for each place. Cells meet it by the block they are in and test one bit, whatever their time; the
polygon's bounds reach the reader.

`grid` is the survey of a rectilinear grid (`sources.survey`). Edges count as inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.scalars import half_cell
from cellwright.session import settle
from cellwright.sources.survey import axis, extents, highest, lowest, tiles

BAND_DEGREES = 1.0
TOP, BLOCK = 256, 16
_WORDS = BLOCK * BLOCK // 64


def _line(grid: DataFrame, kind: str) -> DataFrame:
    """position and coordinate of one axis; a position with several coordinates is refused."""
    refused = F.raise_error(F.lit("regions need a grid with one latitude per row and one longitude per column"))
    found = axis(grid, kind).groupBy("position").agg(F.min("coordinate").alias("coordinate"), F.max("to").alias("to"))
    return found.where("coordinate IS NOT NULL").select("position", F.when(F.col("to") == F.col("coordinate"), F.col("coordinate")).otherwise(refused).alias("coordinate"))


def _block(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size).cast("int")


def _bands(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BAND_DEGREES), F.floor(high / BAND_DEGREES)))


def _crossings(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """region_id, row i, the longitudes where edges cross the row, and the parts of it that lie on edges.

    The lists are bounded by the edges of one polygon at one latitude.
    """
    rows = _line(grid, "lat").select(F.col("position").alias("i"), F.col("coordinate").alias("lat")).withColumn("_band", F.floor(F.col("lat") / BAND_DEGREES))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    met = rows.join(edges.withColumn("_band", _bands(low, high)), "_band").where(F.col("lat").between(low, high))
    x = F.col("x1") + (F.col("lat") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    crosses = (F.col("y1") <= F.col("lat")) != (F.col("y2") <= F.col("lat"))
    along = F.when(F.col("y1") == F.col("y2"), F.struct(F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"))).otherwise(F.struct(x.alias("a"), x.alias("b")))
    return met.groupBy("region_id", "i").agg(F.array_agg(F.when(crosses, x)).alias("crossings"), F.array_agg(along).alias("along"))


def _columns(grid: DataFrame) -> DataFrame:
    """One row for each tile of columns: its bounds, and its blocks with their bounds and coordinates."""
    line = _line(grid, "lon").select(F.col("position").alias("j"), F.col("coordinate").alias("lon"), _block("position", BLOCK).alias("bj"))
    blocks = line.groupBy("bj").agg(F.min("lon").alias("lo"), F.max("lon").alias("hi"), F.collect_list(F.struct(F.pmod("j", F.lit(BLOCK)).alias("k"), "lon")).alias("places"))
    return blocks.groupBy(_block("bj", TOP // BLOCK).alias("tj")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("bj", "lo", "hi", "places")).alias("blocks"))


def _tiles(grid: DataFrame) -> DataFrame:
    """The tiles (ti, tj) of the grid that hold cells."""
    def spread(tile: str, out: str) -> Column:
        first = F.col(tile) * F.col("tile")
        return F.explode(F.sequence(F.floor(first / TOP).cast("int"), F.floor((first + F.col("tile") - 1) / TOP).cast("int"))).alias(out)

    rows = tiles(grid).where("tile_i IS NOT NULL AND tile_j IS NOT NULL").select("tile_j", "tile", spread("tile_i", "ti"))
    return rows.select("ti", spread("tile_j", "tj")).distinct()


def _odd(lon: Column) -> Column:
    return F.size(F.filter("crossings", lambda c: c > lon)) % 2 == 1


def _on_edge(lo: Column, hi: Column) -> Column:
    return F.exists("along", lambda e: (e["a"] <= hi) & (e["b"] >= lo))


def _even(lo: Column, hi: Column) -> Column:
    """No crossing parts the places from lo to hi."""
    return ~F.exists("crossings", lambda c: (c > lo) & (c <= hi))


def cover(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """region_id, block (bi, bj) and the bits `m0` to `m3` of its places inside the polygon, row by row."""
    rows = _crossings(grid, edges).withColumn("ti", _block("i", TOP))
    met = rows.join(_tiles(grid), "ti").join(_columns(grid), "tj")
    lo, hi = F.col("lo"), F.col("hi")
    met = met.where(~_even(lo, hi) | _odd(lo) | _on_edge(lo, hi)).select("region_id", "i", "crossings", "along", F.explode("blocks").alias("b"))
    lo, hi = F.col("b.lo"), F.col("b.hi")

    def tested(total: Column, place: Column) -> Column:
        held = _odd(place["lon"]) | _on_edge(place["lon"], place["lon"])
        return total + F.when(held, F.pow(F.lit(2.0), place["k"])).otherwise(0.0).cast("long")

    each = F.aggregate(F.col("b.places"), F.lit(0).cast("long"), tested)
    bits = F.when(_even(lo, hi) & _odd(lo), F.lit((1 << BLOCK) - 1).cast("long")).when(_even(lo, hi) & ~_on_edge(lo, hi), F.lit(0).cast("long")).otherwise(each)
    held = met.select("region_id", _block("i", BLOCK).alias("bi"), F.col("b.bj").alias("bj"), F.pmod("i", F.lit(BLOCK)).cast("int").alias("row"), bits.alias("bits")).where("bits <> 0")
    shifted = F.expr("shiftleft(bits, (row % 4) * 16)")
    words = [F.bit_or(F.when(F.floor(F.col("row") / 4) == w, shifted).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(_WORDS)]
    return settle(held.groupBy("region_id", "bi", "bj").agg(*words), "cover")


def covered(cells: DataFrame, found: DataFrame, how: str = "inner", keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells with the `region_id` of each polygon that holds them; with `keys`, a column of both sides that must agree as well.

    A left join keeps the other cells, with `_inside` false.
    """
    place = F.pmod("i", F.lit(BLOCK)) * BLOCK + F.pmod("j", F.lit(BLOCK))
    word = F.coalesce(*[F.when(F.floor(place / 64) == w, F.col(f"m{w}")) for w in range(_WORDS)])
    marked = cells.withColumns({"bi": _block("i", BLOCK), "bj": _block("j", BLOCK), "_bit": F.pmod(place, F.lit(64)).cast("int"), "_place": place})
    rows = marked.join(found, [*keys, "bi", "bj"], how)
    held = F.coalesce(F.getbit(word, F.col("_bit")) == 1, F.lit(False))
    rows = rows.withColumn("_inside", held).drop("bi", "bj", "_bit", "_place", *[f"m{w}" for w in range(_WORDS)])
    return rows.where("_inside").drop("_inside") if how == "inner" else rows


def bounded(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells within the bounds of all polygons; the bounds reach the reader."""
    for c, a, b in (("lon", "x1", "x2"), ("lat", "y1", "y2")):
        cells = cells.where((F.col(c) >= lowest(edges, F.least(a, b))) & (F.col(c) <= highest(edges, F.greatest(a, b))))
    return cells


def touched(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """region_id, i and j of the cells that an edge of the polygon touches.

    Each row, as high as a cell, cuts a piece out of an edge; the piece meets the columns within its longitudes.
    """
    half = extents(grid).select(F.struct(half_cell("lon_min", "lon_max", "n_lon").alias("hx"), half_cell("lat_min", "lat_max", "n_lat").alias("hy"))).scalar()
    rows = _line(grid, "lat").select(F.col("position").alias("i"), F.col("coordinate").alias("lat"), half.alias("half")).select("i", "lat", "half.hx", "half.hy")
    rows = rows.withColumn("_band", _bands(F.col("lat") - F.col("hy"), F.col("lat") + F.col("hy")))
    met = rows.join(edges.withColumn("_band", _bands(F.least("y1", "y2"), F.greatest("y1", "y2"))), "_band")
    step = F.col("y2") - F.col("y1")
    south, north = F.col("lat") - F.col("hy"), F.col("lat") + F.col("hy")
    t1, t2 = F.try_divide(south - F.col("y1"), step), F.try_divide(north - F.col("y1"), step)
    start = F.when(step == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(t1, t2)))
    end = F.when(step == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(t1, t2)))
    met = met.where((start <= end) & ((step != 0) | F.col("y1").between(south, north)))
    xs = [F.col("x1") + t * (F.col("x2") - F.col("x1")) for t in (start, end)]
    pieces = met.select("region_id", "i", "hx", F.least(*xs).alias("west"), F.greatest(*xs).alias("east")).distinct()
    pieces = pieces.withColumn("_band", _bands(F.col("west") - F.col("hx"), F.col("east") + F.col("hx")))
    columns = _line(grid, "lon").select(F.col("position").alias("j"), F.col("coordinate").alias("lon")).withColumn("_band", F.floor(F.col("lon") / BAND_DEGREES))
    near = pieces.join(columns, "_band").where((F.col("west") <= F.col("lon") + F.col("hx")) & (F.col("east") >= F.col("lon") - F.col("hx")))
    return near.select("region_id", "i", "j").distinct()

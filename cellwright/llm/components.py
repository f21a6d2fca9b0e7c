"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.session import settle

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of a link (u, v).

    Each round hangs neighbours below smaller ones, first the larger neighbours of every vertex, then its smaller
    ones; the number of rounds grows with the logarithm of the longest path. The links stay in tables; only
    a count and a checksum reach the driver. Both stars pre-aggregate, and their joins can be split by key.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars, seen = settle(ordered, "links"), None
    for _ in range(ROUNDS):
        stars = settle(_small(_large(stars)), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    centres = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(centres)


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

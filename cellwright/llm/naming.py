"""Exact deduplication by deterministic block naming, in built-in expressions.

A text is cut into blocks of BLOCK code points. The distinct blocks are sorted, and the place of a block in that order
is its integer name. Then adjacent names of a text are paired, the distinct pairs are sorted and named in turn, and so
on, until each text has one name. Two texts end with the same name of the same level if and only if they are equal:
a name stands for one block or one pair, never for a hash of it.

The order of the blocks is that of (hash, block), the order of pairs that of (hash, left, right), so that the sort is cut
into buckets by hash: each task brings the distinct blocks of a bucket, not their copies, a bucket holds about
BUCKET names whatever the input, and its sorted array gives the names. A block that shares its 64-bit hash with no other
block is looked up by the hash, which in that case says as much as the block; the others are looked up by the
block itself. Sorted names are written before anything joins them, so a lost executor cannot change them.

A null text is empty. Empty texts have no block and share one identity. Of rows that agree in doc_id and text
one is kept, whichever; a row without doc_id is kept only if its text has no other row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.tables import own_columns
from cellwright.session import settle

BLOCK = 1024
BUCKET = 256
#: Stands in a pair for the missing right neighbour of the last name of an odd number of them.
_NONE = -1
#: Names are bucket * 2**31 + place.
_PLACES = 31


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The consecutive blocks of a text, in one pass over it; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))


def hashed(value: Column) -> Column:
    return F.xxhash64(value)


def _sorted_names(items: DataFrame, count: int, bucket: int) -> DataFrame:
    """key, item, name and `alone` (no other item has the key) of each distinct item (key, item)."""
    held = items.withColumn("bucket", F.pmod("key", F.lit(max(1, -(-count // bucket))))).groupBy("bucket")
    held = held.agg(F.array_sort(F.collect_set(F.struct("key", "item"))).alias("items"))

    def placed(x: Column, k: Column) -> Column:
        before, after = F.get("items", k - 1)["key"], F.get("items", k + 1)["key"]
        alone = F.coalesce(before != x["key"], F.lit(True)) & F.coalesce(after != x["key"], F.lit(True))
        return F.struct(x["key"].alias("key"), x["item"].alias("item"), (F.shiftleft("bucket", _PLACES) + k).alias("name"), alone.alias("alone"))

    return held.select(F.inline(F.transform("items", placed)))


def _first_names(numbered: DataFrame, rows: DataFrame, size: int, bucket: int) -> DataFrame:
    """row and the names of its blocks, in order."""
    count = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    items = numbered.select(F.explode(blocks(_text(), size)).alias("item")).select(hashed(F.col("item")).alias("key"), "item")
    names = _sorted_names(items, count, bucket).withColumn("item", F.when(~F.col("alone"), F.col("item")))  # the others leave their text here
    names = settle(names, "names0")
    places = rows.select("row", F.posexplode("keys").alias("pos", "key"))
    found = places.join(names.where("alone").select("key", "name"), "key").select("row", "pos", "name")
    shared = names.where("NOT alone").select("key", "item", "name")
    if not shared.isEmpty():  # different blocks with one hash: the rows that hold any of them bring their blocks
        owners = places.join(shared.select("key").distinct(), "key", "left_semi").select("row").distinct()
        texts = numbered.select("row", _text().alias("text")).join(owners, "row", "left_semi")
        owned = texts.select("row", F.posexplode(blocks(F.col("text"), size)).alias("pos", "item")).withColumn("key", hashed(F.col("item")))
        found = found.union(owned.join(shared, ["key", "item"]).select("row", "pos", "name"))
    return _in_order(found)


def _in_order(places: DataFrame) -> DataFrame:
    held = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("held"))
    return held.select("row", F.col("held.name").alias("names"))


def _paired(state: DataFrame, count: int, level: int, bucket: int) -> DataFrame:
    """The next level of the texts that still have several names."""
    pair = F.transform(F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)), lambda k: F.struct(
        F.get("names", k).alias("left"), F.coalesce(F.get("names", k + 1), F.lit(_NONE).cast("long")).alias("right")))
    pairs = state.select("row", F.posexplode(pair).alias("pos", "item"))
    items = pairs.select(hashed(F.col("item")).alias("key"), "item")
    names = settle(_sorted_names(items, count, bucket).select("item", "name"), f"names{level}")
    return _in_order(pairs.join(names, "item").select("row", "pos", "name"))


def _identities(numbered: DataFrame, rows: DataFrame, size: int, bucket: int) -> DataFrame:
    """row, level and name: the identity of each text. Each level halves the names: as many levels as the longest text has binary places."""
    done = [rows.where(F.size("keys") == 0).select("row", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))]
    level, state = 0, settle(_first_names(numbered, rows, size, bucket), "level0")
    while True:
        done.append(state.where(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.get("names", F.lit(0)).alias("name")))
        several = state.where(F.size("names") > 1)
        count = several.agg(F.sum(F.ceil(F.size("names") / 2))).first()[0]
        if not count:
            return reduce(DataFrame.union, done)
        level += 1
        state = settle(_paired(several, count, level, bucket), f"level{level}")


def _judged(numbered: DataFrame, size: int, bucket: int) -> DataFrame:
    keys = F.transform(blocks(_text(), size), lambda b: hashed(b))
    rows = settle(numbered.select("row", "doc_id", F.sha2(_text().cast("binary"), 256).alias("text_sha256"), keys.alias("keys")), "rows")
    found = settle(rows.select("row", "doc_id", "text_sha256").join(_identities(numbered, rows, size, bucket), "row"), "identities")
    # written, so that the join with them is one of plain tables, which Spark splits where a group is large
    classes = settle(found.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")), "classes")
    return found.join(classes, ["level", "name"]).select(
        "row", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256")


def groups(docs: DataFrame, size: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, keep_id (the largest doc_id of the equal texts), group_size, kept and text_sha256 of every row.

    `docs` is read twice with its rows numbered by place, so it must be a stored table.
    """
    return _judged(own_columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), size, bucket).drop("row")


def deduplicate(docs: DataFrame, size: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts that with the largest doc_id."""
    number = "row"
    while number in docs.columns:
        number += "_"
    stored = settle(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    kept = _judged(stored.select(F.col(number).alias("row"), "doc_id", "text"), size, bucket).where("kept").select(F.col("row").alias(number))
    return stored.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

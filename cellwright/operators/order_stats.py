"""Exact order statistics of groups of any size, by counting and narrowing.

Spark's exact `percentile` keeps every distinct value of a group in one aggregation buffer, and
`row_number` sorts a group in one task. Both fail when one group holds a large share of the rows.
Here a finite double becomes a 64-bit integer of the same order, and a position is narrowed in rounds: each counts the values
of a group by their next bits (DIGITS), among those that agree with what is known so far, and picks the
bits in which the position lies. Counts are combined in the tasks that read the rows, and a group has at most 2**22 of
them in a round whatever its size; the rows themselves are neither written nor sorted. What a round finds, one row per
group and position, is written, so that Spark knows its size when the rows meet it. The input is read once per
round: settle a frame that is dear to compute.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.scalars import finite
from cellwright.session import settle

DIGITS = (22, 21, 21)
_MANTISSA, _LEAST = 52, -1022


def _guess(size: Column) -> Column:
    return F.floor(F.log2(size))


def _power(size: Column, guess: Column) -> Column:
    # the logarithm may be off by one next to a power of two
    exact = guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when(size < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    return F.greatest(F.lit(_LEAST), F.least(F.lit(-_LEAST + 1), exact))


def _bits(value: Column, size: Column, power: Column) -> Column:
    normal = (power - _LEAST + 1) * F.lit(1 << _MANTISSA) + ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << _MANTISSA)).cast("long")
    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")
    bits = F.when(size < 2.0 ** _LEAST, tiny).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def ordered(value: Column) -> Column:
    """An integer of the same order as a finite double, one for each double; both zeros are 0."""
    size = F.abs(value)
    return _bits(value, size, _power(size, _guess(size)))


def _with_order(rows: DataFrame) -> DataFrame:
    """`_x`, the integer of `_v`, step by step, so that no step is written into the next one more than once."""
    rows = rows.withColumn("_size", F.abs("_v")).withColumn("_guess", _guess(F.col("_size")))
    rows = rows.withColumn("_power", _power(F.col("_size"), F.col("_guess")))
    return rows.withColumn("_x", _bits(F.col("_v"), F.col("_size"), F.col("_power"))).drop("_size", "_guess", "_power")


def unordered(bits: Column) -> Column:
    """The double of an integer made by `ordered`."""
    size = F.abs(bits)
    power = F.shiftright(size, _MANTISSA)
    rest = size.bitwiseAND(F.lit((1 << _MANTISSA) - 1))
    # power 0 holds the doubles below 2**-1022, which share the scale of power 1
    normal = (1 + rest / F.lit(float(1 << _MANTISSA))) * F.pow(F.lit(2.0), power + _LEAST - 1)
    found = F.when(power == 0, rest * F.lit(2.0 ** -537) * F.lit(2.0 ** -537)).otherwise(normal)
    return F.when(bits < 0, -found).otherwise(found)


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    positions: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Values at exact 0-based positions of each group's sorted finite values.

    `positions` maps an output name to a function from the group's count `n` to a position.
    Returns one row per group with its keys, `n` and the picked values, NULL for a group without
    finite values.
    """
    names, group = list(positions), [f"_k{n}" for n in range(len(keys))]
    rows = df.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], finite(value).alias("_v"))
    coded = _with_order(rows)
    counted = lambda rows, *by: rows.groupBy(*group, *by, "_digit").agg(F.count(F.lit(1)).alias("_c"))

    # The first digits hold the sign, so they are in order as well. Values that do not count have none.
    left = 64 - DIGITS[0]
    counts = counted(coded.withColumn("_digit", F.shiftright("_x", left))).withColumn("_c", F.when(F.col("_digit").isNotNull(), F.col("_c")).otherwise(0))
    whole = Window.partitionBy(*group)
    order = whole.orderBy("_digit")
    counts = counts.withColumns({"_end": F.sum("_c").over(order), "_n": F.sum("_c").over(whole), "_first": F.row_number().over(order) == 1})
    sought = F.array(*[F.struct(F.lit(x).alias("name"), positions[x](F.col("_n")).cast("long").alias("at")) for x in names])
    sought = F.filter(sought, lambda s: (s["at"] >= F.col("_end") - F.col("_c")) & (s["at"] < F.col("_end")))
    # a row without a name tells of the group, also of one without finite values
    each = F.when(F.col("_first"), F.array_append(sought, F.lit(None))).otherwise(sought)
    found = counts.withColumn("_s", F.explode(each)).select(
        *group, "_n", F.col("_s.name").alias("_name"), F.col("_digit").alias("_prefix"), (F.col("_s.at") - F.col("_end") + F.col("_c")).alias("_at"))
    groups = found = settle(found, "digits")
    # known to be there, so that no join asks for it once more
    coded = _with_order(rows.where(F.col("_v").isNotNull())).withColumn("_x", F.coalesce("_x", F.lit(0).cast("long")))
    for bits in DIGITS[1:]:
        left -= bits
        reach = coded.withColumns({"_p": F.shiftright("_x", left + bits), "_digit": F.shiftright("_x", left).bitwiseAND(F.lit((1 << bits) - 1))})
        wanted = found.where("_name IS NOT NULL").select(*[F.col(g).alias(f"{g}w") for g in group], "_name", "_prefix", "_at")
        same = F.col("_p") == F.col("_prefix")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}w"))
        counts = counted(reach.join(wanted, same), "_name", "_prefix", "_at")
        counts = counts.withColumn("_end", F.sum("_c").over(Window.partitionBy(*group, "_name").orderBy("_digit")))
        start = F.col("_end") - F.col("_c")
        found = settle(counts.where((F.col("_at") < F.col("_end")) & (F.col("_at") >= start)).select(
            *group, "_name", (F.shiftleft("_prefix", bits) + F.col("_digit")).alias("_prefix"), (F.col("_at") - start).alias("_at")), "digits")
    picked = found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == x, unordered(F.col("_prefix")))).alias(x) for x in names])
    if not keys:
        one = picked.select(F.struct(*names)).scalar()
        sizes = groups.groupBy().agg(F.coalesce(F.max("_n"), F.lit(0).cast("long")).alias("n"))
        return sizes.withColumn("_p", one).select("n", *[F.col(f"_p.{x}").alias(x) for x in names])
    sizes = groups.where("_name IS NULL").select(*[F.col(g).alias(k) for k, g in zip(keys, group, strict=True)], F.col("_n").alias("n"))
    same = F.lit(True)
    for k, g in zip(keys, group, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(g))
    return sizes.join(picked, same, "left").select(*keys, "n", *names)


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group; `probs` maps output names to fractions."""
    positions: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        positions[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        positions[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
    picked = values_at(df, keys, value, positions)
    out = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, "n", *out)


def ordinal(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], out: str) -> DataFrame:
    """Add the 0-based row position within each group, sorting one bucket per task.

    `bucket` must not decrease along `order`. The offsets table holds one row per bucket.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    offsets = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket") if not keys else Window.partitionBy(*keys).orderBy("_bucket")
    offsets = offsets.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_row", F.row_number().over(within))
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_row") - 1)
        .drop("_bucket", "_before", "_row")
    )

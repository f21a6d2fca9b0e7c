"""What a result rests on, as rows: one for each panel, and one for several panels together.

A fact is kept where all rows it is said of agree, and is missing where they differ or one of them lacks it. That rule can be
applied again and again in any order, so panels may be merged pairwise, by product, or all at once. Counts and rates
describe one region, and are dropped as soon as two panels meet, as is the evidence of a panel, which is not part of the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.scalars import is_finite
from cellwright.operators.reductions import label_columns, qa_counters

#: Facts that the caller knows of the cells: what was plotted, where its masks came from, and what the numbers mean.
STATED = ("variable", "units", "fill_value_source", "valid_range_source", "qa_status", "qa_source", "region_type", "basis")
COUNTED = ("checked", "passing", "flag_missing", "pass_rate", "n_time", "n_lat", "n_lon")
DATED = ("n_granules", "start_date", "end_date", "aggregation_label")


def agreed(fact: Column | str) -> Column:
    """The value that all rows of a group have, NULL when they differ or any lacks it."""
    fact = F.col(fact) if isinstance(fact, str) else fact
    return F.when((F.count(fact) == F.count(F.lit(1))) & (F.min(fact) == F.max(fact)), F.min(fact))


def panel_provenance(
    cells: DataFrame, keys: Sequence[str], cadence: str, stat: str = "mean", good=None, bad=None, stated: dict[str, Column | str | None] | None = None
) -> DataFrame:
    """One row per panel of narrowed and masked cells, from one pass over them.

    `stated` names the facts of STATED that are known, as text or as expressions over the cells; an expression must
    hold for the whole panel. Without a quality rule the counters are missing, because no mask ran.
    """
    stated = stated or {}
    facts = {n: stated.get(n) for n in STATED}
    valid = F.when(is_finite("value"), F.col("ts"))
    ran = good is not None or bad is not None
    counters = {n: c if ran else F.lit(None).cast(k) for (n, c), k in zip((qa_counters(good, bad) if ran else qa_counters([], None)).items(), ("long", "long", "long", "double"), strict=True)}
    counters |= {n: F.count_distinct(F.when(F.col("checked").isNotNull(), F.col(c))) if ran else F.lit(None).cast("long") for n, c in (("n_time", "ts"), ("n_lat", "i"), ("n_lon", "j"))}
    rows = cells.groupBy(*keys).agg(
        *[(agreed(v) if isinstance(v, Column) else F.lit(v).cast("string")).alias(n) for n, v in facts.items()],
        *[c.alias(n) for n, c in counters.items()],
        F.count_distinct(valid).alias("n_granules"), F.to_date(F.min(valid)).alias("_start"), F.to_date(F.max(valid)).alias("_end"),
    )
    label, _ = label_columns(cadence, stat)
    named = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    return rows.select(
        F.array(named).alias("panels"), *STATED, *COUNTED, "n_granules", F.col("_start").cast("string").alias("start_date"),
        F.col("_end").cast("string").alias("end_date"), label.alias("aggregation_label"))


def merge_provenance(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for all panels, or for those that share `keys`: their names in order, and the facts true of all of them.

    The row of a single panel stays as it is; that of several has no counts, which are true of one region only.
    """
    several = F.sum(F.size("panels")) > 1
    return rows.groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("panels"))).alias("panels"), *[agreed(n).alias(n) for n in STATED],
        *[F.when(~several, F.max(n)).alias(n) for n in COUNTED], *[agreed(n).alias(n) for n in DATED])

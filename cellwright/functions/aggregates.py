"""Aggregate expressions. All are algebraic (partial aggregation before any shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.functions.scalars import cos_weight, finite, is_finite, _c


def weighted_mean(value: Column | str, lat: Column | str | None = "lat") -> Column:
    """Cosine-latitude mean over the cells that hold a value; the plain mean without a latitude.

    NULL when no value is left or when an infinite value makes the mean meaningless.
    """
    v = _c(value)
    w = F.lit(1.0) if lat is None else cos_weight(lat)
    mean = F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))
    return F.when(F.max(F.when(is_finite(v), 1)) == 1, finite(mean))


def values_stat(value: Column | str, stat: str) -> Column:
    """Unweighted statistic over finite values. `median` is exact and meant for bounded groups."""
    v = finite(value)
    if stat == "mean":
        return F.avg(v)
    if stat == "median":
        return F.median(v)
    if stat == "max":
        return F.max(v)
    if stat == "min":
        return F.min(v)
    if stat == "std":
        return F.stddev_samp(v)
    raise ValueError(f"Unsupported statistic '{stat}'. Valid: mean, median, max, min, std")


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r, NULL for fewer than two pairs or a constant side."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    constant = (F.min(px) == F.max(px)) | (F.min(py) == F.max(py))
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when((F.count(F.when(both, 1)) >= 2) & ~constant, r)

"""Scalar column expressions. All run JVM-side inside whole-stage codegen where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EARTH_RADIUS_MILES = 3958.8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite (never NULL itself)."""
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INF)), F.lit(False))


def finite(x: Column | str) -> Column:
    return F.when(is_finite(x), _c(x))


def nan_to_null(x: Column | str) -> Column:
    """Missing cells are NULL in this library; decoded arrays carry NaN."""
    return F.when(~F.isnan(_c(x)), _c(x))


def cos_weight(lat: Column | str) -> Column:
    """Cell area weight of a latitude, never negative at the poles."""
    return F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.0))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def float_or_none(x: Column | str) -> Column:
    """A number held as text; empty or unreadable text is missing."""
    return F.nullif(F.trim(_c(x).cast("string")), F.lit("")).try_cast("double")


def round6(x: Column | str) -> Column:
    return F.round(_c(x), 6)


def sig7(x: Column | str) -> Column:
    """Seven significant digits, through the scientific text form with six decimals."""
    return F.when(is_finite(x), F.format_string("%.6e", _c(x)).cast("double"))


def site_id(state="state_code", county="county_code", site="site_number") -> Column:
    return F.concat_ws("-", *[F.coalesce(_c(p), F.lit("??")) for p in (state, county, site)])


def period_key(period: str) -> Column:
    """Key of a ground record's reporting period: a date, `2024-Q1`, or a year."""
    if period == "daily":
        return F.coalesce(F.col("date_local").cast("string"), F.lit(""))
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    if period == "quarterly":
        return F.concat(year, F.lit("-Q"), F.coalesce(F.col("quarter").cast("string"), F.lit("")))
    if period == "annual":
        return year
    raise ValueError(f"unknown period: {period}")


def half_cell(vmin, vmax, n) -> Column:
    """Half the spacing of an axis; half a degree for an axis of one cell."""
    vmin, vmax, n = map(_c, (vmin, vmax, n))
    return F.when(n > 1, F.abs(vmax - vmin) / (n - 1) / 2).otherwise(F.lit(0.5))


def color_index(value, vmin, vmax, n_colors: int) -> Column:
    """Index into a colour table; halves go to the even index."""
    value, vmin, vmax = map(_c, (value, vmin, vmax))
    span = F.when(vmax - vmin == 0, F.lit(1.0)).otherwise(vmax - vmin)
    share = F.least(F.greatest((value - vmin) / span, F.lit(0.0)), F.lit(1.0))
    return F.when(is_finite(value), F.bround(share * (n_colors - 1), 0).cast("int"))


def leaf(name: Column | str) -> Column:
    """Last path segment of a group-qualified variable name."""
    return F.element_at(F.split(_c(name), "/"), -1)


def group_of(name: Column | str) -> Column:
    """Everything before the last slash, or NULL for a bare name."""
    return F.when(F.instr(_c(name), "/") > 0, F.regexp_replace(_c(name), "/[^/]*$", ""))


def normalized(name: Column | str) -> Column:
    """Letters and digits only, in lower case, so CamelCase and snake_case compare equal."""
    return F.regexp_replace(F.lower(F.coalesce(_c(name), F.lit(""))), "[^a-z0-9]", "")


def coverage_decile(fraction: Column | str) -> Column:
    f = F.coalesce(_c(fraction), F.lit(0.0))
    return F.when(f <= 0, F.lit(0)).otherwise(F.least(F.lit(10), F.floor(f * 10).cast("int")))


def contains_any(text: Column, needles) -> Column:
    cond = F.lit(False)
    for needle in needles:
        cond = cond | F.contains(text, F.lit(needle))
    return cond


def ends_with_any(text: Column, suffixes) -> Column:
    cond = F.lit(False)
    for suffix in suffixes:
        cond = cond | F.endswith(text, F.lit(suffix))
    return cond


def date_part(text: Column | str) -> Column:
    """Date part of ISO text; empty text is missing."""
    return F.nullif(F.trim(F.substring_index(_c(text), "T", 1)), F.lit(""))


def place_key(name: Column | str) -> Column:
    """Leading locality of a place name, folded, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.substring_index(_c(name), ",", 1), r"\s+", " ")))


def text_ts(ts: Column | str) -> Column:
    return _c(ts).cast("string")

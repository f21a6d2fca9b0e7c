"""Spans of a text as built-in expressions: code point positions of pattern matches, digests and redaction.

Patterns are written without backtracking over what they have taken (possessive), so their cost is linear
and their stack does not grow with the text. Running sums and the pieces of a text are made in two levels, of STEP spans and of
PIECE code points, so that texts with many matches do not copy what they have so far for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A match with what lies between it and its neighbours.
HIT = "array<struct<start: int, end: int, value: string, before: string, after: string>>"
#: A span of some kind; `rank` orders the kinds.
SPAN = "array<struct<rank: int, kind: string, start: int, end: int>>"


STEP = 64
PIECE = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once; inside a lambda an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, what the ones before it come to from 0 on, by sums or maxima."""
    zero = F.lit(0)
    none = F.array().cast("array<int>")

    def step(state: Column, value: Column) -> Column:
        return F.struct(join(state["at"], value).alias("at"), F.concat(state["before"], F.array(state["at"])).alias("before"))

    def before(some: Column) -> Column:
        return F.aggregate(some, F.struct(zero.alias("at"), none.alias("before")), step)

    def parted(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / STEP).cast("int")
        return F.transform(F.sequence(zero, last), lambda k: before(F.slice(held, k * STEP + 1, F.lit(STEP))))

    def whole(parts: Column) -> Column:
        bases = before(F.transform(parts, lambda p: p["at"]))["before"]
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["before"], lambda x: join(base, x))))

    return bound(values, lambda held: F.when(F.size(held) > 0, bound(parted(held), whole)).otherwise(none))


def located(text: Column, pattern: str, around: int = 0) -> Column:
    """All matches, leftmost and without overlap, with up to `around` code points of text on both sides.

    The gaps between the matches come from splitting at the same pattern; positions are running lengths.
    """
    size = F.char_length

    def hit(row: Column, at: Column) -> Column:
        start = at + size(row["before"])
        before = F.when(F.lit(around) > 0, F.right(row["before"], F.lit(around))).otherwise("")
        return F.struct(start.alias("start"), (start + size(row["value"])).alias("end"), row["value"].alias("value"), before.alias("before"),
                        F.left(row["after"], F.lit(around)).alias("after"))

    def rows(gaps: Column) -> Column:
        befores, afters = F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.slice(gaps, F.lit(2), F.size(gaps) - 1)
        return F.zip_with(F.arrays_zip(befores.alias("before"), afters.alias("after")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                          lambda g, v: F.struct(g["before"].alias("before"), v.alias("value"), g["after"].alias("after")))

    def hits(found: Column) -> Column:
        starts = running(F.transform(found, lambda r: size(r["before"]) + size(r["value"])), lambda a, b: a + b)
        return F.zip_with(found, starts, hit)

    parts = bound(F.split(text, pattern, -1), rows)
    return bound(parts, lambda found: F.when(F.size(found) > 0, hits(found)).otherwise(F.array())).cast(HIT)


def as_spans(hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: Column) -> Column:
    return F.sha2(written(spans), 256)


def by_start(spans: Column) -> Column:
    """Ordered by start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["rank"].alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def redacted(text: Column, spans: Column, placeholder: Callable[[Column], Column]) -> Column:
    """The text with each span replaced; spans that overlap count as one, of the first one's kind."""
    def between(pieces: Column, start: Column, end: Column) -> Column:
        """The code points from start to end, from the pieces that they touch."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        several = F.concat(F.substring(piece(first), start % PIECE + 1, F.lit(PIECE)), inner, F.substring(piece(last), F.lit(1), end % PIECE))
        return F.when(end <= start, "").when(first == last, F.substring(piece(first), start % PIECE + 1, end - start)).otherwise(several)

    def whole(held: Column) -> Column:
        """held: the pieces, and the spans in order."""
        ends = running(F.transform(held["spans"], lambda s: s["end"]), F.greatest)
        own = F.zip_with(held["spans"], ends, lambda s, done: F.when(s["start"] >= done, F.concat(between(held["pieces"], done, s["start"]), placeholder(s["kind"]))).otherwise(""))
        rest = between(held["pieces"], F.array_max(F.transform(held["spans"], lambda s: s["end"])), held["size"])
        return F.concat(F.array_join(own, ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    held = F.struct(pieces.alias("pieces"), by_start(spans).alias("spans"), F.char_length(text).alias("size"))
    return F.when(F.size(spans) > 0, bound(held, whole)).otherwise(text)


def keyed(docs: DataFrame) -> DataFrame:
    """With `row_key`, which tells rows apart by id and text: rows alike in both have the same spans. A null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("row_key", F.struct(
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash"), F.char_length("text").alias("size")))

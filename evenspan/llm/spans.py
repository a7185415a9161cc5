"""Spans of pattern matches in texts, with SQL functions only.

Spark has the matches of a pattern, and the pieces of a text between them, but not their places.  Both follow from
the same leftmost, non-overlapping search, so a match starts after all pieces and matches before it.  Offsets count
code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"
PLACE = "array<struct<kind:string,s:int,e:int>>"


#: Lengths are summed in blocks of this many, so that many matches in a text don't cost the square of their number.
STEP = 64


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda it would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column) -> Column:
    """For each place of a non-empty array, the sum of the places before it."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def blocks(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda b: total(F.slice(x, b * STEP + 1, F.lit(STEP))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, first, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def places(x: Column, starts: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            b = F.floor(i / STEP).cast("int")
            return F.get(starts, b) + total(F.slice(x, b * STEP + 1, i - b * STEP))

        return F.transform(x, at)

    return bound(lengths, lambda x: bound(blocks(x), lambda starts: places(x, starts)))


def matches(text: Column, pattern: str | Column, kind: str) -> Column:
    """An array of (kind, s, e, v), in order; empty for a null text."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def placed(m: Column) -> Column:
        pieces = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), lambda g: F.length(g))

        def spans(g: Column) -> Column:
            before = sums_before(F.zip_with(g, m, lambda x, y: x + F.length(y)))
            starts = F.zip_with(before, g, lambda x, y: x + y)
            return F.zip_with(starts, m, lambda x, y: F.struct(F.lit(kind).alias("kind"), x.alias("s"), (x + F.length(y)).alias("e"), y.alias("v")))

        return bound(pieces, spans)

    empty = F.array().cast(SPAN)
    return bound(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def placed(spans: Column) -> Column:
    """kind, s and e only: places may be stored, what stands there may not."""
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def by_start(spans: Column, kinds: list[str]) -> Column:
    """kind, s and e, ordered by start, then by kind as listed."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.array_position(rank, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    return placed(F.array_sort(keyed))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))


def overlaid(text: Column, spans: Column, mark) -> Column:
    """The text with each span replaced by ``mark(kind)``; spans are in order and apart."""
    return F.aggregate(F.reverse(spans), text, lambda acc, x: F.overlay(acc, mark(x["kind"]), x["s"] + 1, x["e"] - x["s"]))

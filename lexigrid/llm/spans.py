"""Spans of regular expressions in native expressions: code points, end exclusive.

Spark has the texts of all matches and the pieces between them; running sums of their lengths give the places. The patterns use
possessive loops (no recursion on long runs) and start a run only where a leftmost search could (linear on long runs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,val:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """op over an array<bigint> up to each place (sums, say), in two levels: within blocks as long as the square root of the
    array, and over the blocks. A fold that appends copies its array at each step, so it only ever holds a block, or the blocks."""
    none = F.array().cast("array<bigint>")
    step = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), lambda k: F.slice(values, k * step + 1, step))
    append = lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, op(F.try_element_at(out, F.lit(-1)), x)).otherwise(x)))

    def joined(inner: Column) -> Column:
        totals = F.aggregate(F.transform(inner, lambda b: F.element_at(b, -1)), none, append)
        return let(totals, lambda t: F.flatten(F.transform(inner, lambda b, k: F.transform(b, lambda x: F.when(k > 0, op(F.get(t, k - 1), x)).otherwise(x)))))

    return F.when(F.size(values) < 1, none).otherwise(let(F.transform(blocks, lambda b: F.aggregate(b, none, append)), joined))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, val>> of the leftmost non-overlapping matches; the pattern matches no empty text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(v: Column) -> Column:
        moves = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(v)), lambda gap, i: (F.length(gap) + F.length(F.get(v, i))).cast("long"))
        span = lambda val, end: F.struct((end - F.length(val)).alias("start"), end.alias("end"), val.alias("val"))
        return let(moves, lambda m: F.zip_with(v, running(m), span))

    return let(found, lambda v: F.when(F.size(v) < 1, none()).otherwise(placed(v)))


def none() -> Column:
    return F.array().cast(SPAN)


def texts(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def apart(spans: Column, taken: Column) -> Column:
    """The spans, in order, that overlap none of taken: of all sorted by start, the ends before and the starts after tell."""
    far = F.lit(1 << 62)
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["val"].alias("val"), F.lit(own).alias("own"))

    def sifted(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(m, lambda x: F.when(x["own"], far).otherwise(x["start"]))), F.least))
        free = lambda e: lambda s: F.filter(m, lambda x, i: x["own"] & (F.get(e, i) <= x["start"]) & (F.get(s, i) >= x["end"]))
        return F.transform(let(ends, lambda e: let(starts, free(e))), lambda x: F.struct(x["start"], x["end"], x["val"]))

    every = F.array_sort(F.concat(F.transform(spans, mark(True)), F.transform(taken, mark(False))))
    return F.when((F.size(taken) < 1) | (F.size(spans) < 1), spans).otherwise(let(every, sifted).cast(SPAN))

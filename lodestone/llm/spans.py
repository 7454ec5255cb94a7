"""Spans of regular expressions in texts, with code point offsets, by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,rank:int,start:int,end:int,hit:string>>"


#: Values that are folded at a time; a power of 2.
STEP = 64


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold, zero: int = 0) -> Column:
    """The fold of all values before each place of an array of integers. In blocks of STEP, so that the work stays near the number of values."""
    shift = STEP.bit_length() - 1

    def over(vs):
        each = F.transform(blocks_of(vs), lambda b: F.aggregate(F.slice(vs, b * STEP + 1, F.lit(STEP)), F.lit(zero), fold))
        before = let(each, lambda es: F.transform(es, lambda _, b: F.aggregate(F.slice(es, F.lit(1), b), F.lit(zero), fold)))
        return let(before, lambda bs: F.transform(vs, lambda _, i: fold(F.get(bs, F.shiftright(i, shift)), F.aggregate(F.slice(vs, i - i % STEP + 1, i % STEP), F.lit(zero), fold))))

    return let(values, over)


def find(text: Column, kind: str, rank: int, pattern: str, possible: Column) -> Column:
    """Leftmost non-overlapping matches of pattern as an array of (kind, rank, start, end, hit); possible: a cheap test that must hold where there are any.

    What lies between the matches and the matches themselves give the offsets.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")))

    def spans(xs):
        past = running(F.transform(xs, lambda x: x["gap"] + x["size"]), lambda a, v: a + v)

        def one(x, before):
            start = before + x["gap"]
            return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), (start + x["size"]).alias("end"), x["hit"].alias("hit"))

        return F.zip_with(xs, past, one)

    return F.when(possible, let(steps, spans)).otherwise(none())


def blocks_of(xs: Column) -> Column:
    """Numbers of the blocks of STEP values of an array."""
    return F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))


def in_context(text: Column, spans: Column, width: int) -> Column:
    """Spans in order of their starts, each with the width code points before it and the one after it.

    STEP spans share one look into the text, whose code points have to be counted from its start.
    """

    def over(xs):
        def block(b):
            low = F.greatest(F.get(xs, b * STEP)["start"] - width, F.lit(0))
            part = F.substr(text, low + 1, F.get(xs, F.least((b + 1) * STEP, F.size(xs)) - 1)["end"] + 1 - low)

            def one(x, t):
                at = x["start"] - low
                return F.struct(x.alias("span"), F.substr(t, F.greatest(at - width, F.lit(0)) + 1, F.least(at, F.lit(width))).alias("before"), F.substr(t, x["end"] - low + 1, F.lit(1)).alias("after"))

            return let(part, lambda t: F.transform(F.slice(xs, b * STEP + 1, F.lit(STEP)), lambda x: one(x, t)))

        return F.flatten(F.transform(blocks_of(xs), block))

    return let(spans, over)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each span (start, end; ordered by start, at least one) replaced by mask, overlapping ones by one.

    STEP spans share one look into the text, whose code points have to be counted from its start.
    """

    def over(xs):
        past = running(F.transform(xs, lambda x: x["end"]), lambda a, v: F.greatest(a, v))

        def pieces(ends):
            def block(b):
                first, last = b * STEP, F.least((b + 1) * STEP, F.size(xs)) - 1
                low = F.get(ends, first)
                high = F.greatest(F.get(ends, last), F.get(xs, last)["end"])
                part = F.substr(text, low + 1, F.greatest(high - low, F.lit(0)))

                def one(x, end, t):
                    return F.when(x["start"] >= end, F.concat(F.substr(t, end - low + 1, x["start"] - end), F.lit(mask))).otherwise(F.lit(""))

                return let(part, lambda t: F.array_join(F.zip_with(F.slice(xs, first + 1, F.lit(STEP)), F.slice(ends, first + 1, F.lit(STEP)), lambda x, end: one(x, end, t)), ""))

            rest = F.substr(text, F.greatest(F.element_at(ends, -1), F.element_at(xs, -1)["end"]) + 1)
            return F.concat(F.array_join(F.transform(blocks_of(xs), block), ""), rest)

        return let(past, pieces)

    return let(spans, over)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas, in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_kind(spans: Column) -> Column:
    """Ordered by kind as listed, then start."""
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def by_start(spans: Column) -> Column:
    """Ordered by start, then kind as listed."""
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

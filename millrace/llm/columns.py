"""Building blocks of native column expressions over arrays.

A lambda's body is evaluated for each element, with all that it mentions: values that it needs from outside are bound
by ``let`` first, so that each is computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.arrays import let

#: Prefix sums are built in runs of this many elements, as each step copies the run.
RUN = 256
#: Code points of a chunk of a text that is cut.
CHUNK = 4096


def last(items: Column) -> Column:
    return F.element_at(items, -1)


def _prefixes(items: Column, put: Callable[[Column, Column], Column]) -> Column:
    """What ``put``, of which 0 is the neutral element, makes of the elements up to and with each one of an array of longs."""
    zero = F.array(F.lit(0).cast("bigint"))

    def along(values: Column) -> Column:
        return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(put(last(acc), x))))

    def runs(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(RUN)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: along(F.slice(values, k * RUN + 1, RUN)))

    def joined(parts: Column) -> Column:
        return let(
            along(F.transform(parts, last)),
            lambda bases: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, F.size(p)), lambda x: put(x, F.get(bases, k))))),
        )

    return let(items, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(let(runs(v), joined)))


def prefix_sums(items: Column) -> Column:
    """Sums up to and with each element of an array of longs; an empty array for an empty one."""
    return _prefixes(items, lambda a, b: a + b)


def running_max(items: Column) -> Column:
    """The largest element up to and with each one of an array of longs from 0 on."""
    return _prefixes(items, lambda a, b: F.greatest(a, b))


def cut_spans(text: Column, spans: Column) -> Column:
    """The pieces of a text, as an array, that spans ``(start, end)`` of code points name. A text is cut into chunks once, so a piece costs its length and a chunk."""
    whole = lambda x: F.floor(x / F.lit(CHUNK)).cast("int")

    def piece(chunks: Column, s: Column) -> Column:
        def part(k: Column) -> Column:
            first = F.greatest(s["start"] - k * CHUNK, F.lit(0)).cast("int")
            return F.substring(F.get(chunks, k), first + 1, F.least(s["end"] - k * CHUNK, F.lit(CHUNK)).cast("int") - first)

        inside = F.array_join(F.transform(F.sequence(whole(s["start"]), whole(s["end"] - 1)), part), "")
        return F.when(s["end"] > s["start"], inside).otherwise(F.lit(""))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0), lambda chunks: F.transform(spans, lambda s: piece(chunks, s)))


def match_spans(text: Column, pattern: str, hits: Column) -> Column:
    """Code-point spans ``(start, end)`` of the matches ``hits`` of ``pattern``, which never matches an empty string.

    The texts between the matches and the matches themselves alternate, so their lengths add up to the places.
    """
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))

    def spans(between: Column, own: Column) -> Column:
        ends = prefix_sums(F.zip_with(F.slice(between, 1, F.size(own)), own, lambda a, b: a + b))
        return F.zip_with(ends, own, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))

    found = let(lengths(hits), lambda own: let(lengths(F.split(text, pattern, -1)), lambda between: spans(between, own)))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))

"""Sums along arrays, and places of what a pattern finds, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries whose sum is taken at once.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda n, x: n + x)


def sums(numbers: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body(first), where first(n) is the sum of the first n numbers: those of the blocks before, added up once, and the rest of its own block."""

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)).cast("int"), F.lit(BLOCK))
        return F.transform(starts, lambda i: total(F.slice(a, i + 1, F.lit(BLOCK))))

    before = lambda b: F.aggregate(b, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    at = lambda a, top, n: F.get(top, F.floor(n / BLOCK).cast("int")) + total(F.slice(a, (F.floor(n / BLOCK) * BLOCK + 1).cast("int"), (n % BLOCK).cast("int")))
    return let(numbers, lambda a: let(before(blocks(a)), lambda top: body(lambda n: at(a, top, n))))


def running(numbers: Column) -> Column:
    """Running sums. Each adds its own block's entries to the sum of the blocks before, so that the work grows with the array and not with its square."""
    return let(numbers, lambda a: sums(a, lambda first: F.transform(a, lambda _, i: first(i + 1))))


def placed_hits(text: Column, pattern: str) -> Column:
    """start and value of each hit of the pattern in a text, in order."""

    def spans(hits: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long")))
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).cast("long").alias("start"), h.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.split(text, pattern, -1), lambda gaps: spans(hits, gaps)))

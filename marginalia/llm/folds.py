"""Running values over an array inside one row, in DataFrame functions.

A fold that appends to its result copies it at every element, which is
quadratic.  Here an array of n is cut into runs of about the root of n, each
run is folded by itself, and the totals of the runs before are put on top: n
times the root of n.  Empty arrays give empty ones; null elements aren't
allowed for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Combine = Callable[[Column, Column], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(values: Column) -> Column:
    """An array cut into runs of about the root of its length; ``values`` must be bound."""
    n = F.size(values)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    count = F.ceil(n / step).cast("int")
    return F.when(n == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), lambda k: F.slice(values, (k - 1) * step + 1, step)))


def running(values: Column, combine: Combine, zero: Column) -> Column:
    """For each element the combination of those before it, ``zero`` at first; ``combine`` is associative, with ``zero`` as its neutral element."""

    def fold(items: Column) -> Column:
        none = F.slice(F.array(zero), F.lit(1), F.lit(0))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, F.struct(zero.alias("at"), none.alias("out")), step)

    def joined(folded: Column) -> Column:
        before = lambda tops: F.flatten(F.transform(folded, lambda f, k: F.transform(f["out"], lambda x: combine(F.get(tops, k), x))))
        return bound(fold(F.transform(folded, lambda f: f["at"]))["out"], before)

    return bound(values, lambda v: F.when(F.size(v) == 0, F.slice(F.array(zero), F.lit(1), F.lit(0))).otherwise(bound(F.transform(runs(v), fold), joined)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def running_max(values: Column) -> Column:
    """Of numbers that aren't negative."""
    return running(values, F.greatest, F.lit(0))


def following_min(values: Column, most: int = 2**31 - 1) -> Column:
    """For each element the least of those after it."""
    return F.reverse(running(F.reverse(values), F.least, F.lit(most)))

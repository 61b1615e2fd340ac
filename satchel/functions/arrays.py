"""Array functions as columns; positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove(c: Column, at: int, n: int = 1) -> Column:
    return F.concat(F.slice(c, 1, at), F.slice(c, at + n + 1, F.greatest(F.size(c) - (at + n), F.lit(0))))


def insert(c: Column, at: int, value: Column) -> Column:
    return F.concat(F.slice(c, 1, at), F.array(value), F.slice(c, at + 1, F.greatest(F.size(c) - at, F.lit(0))))


def get(c: Column, at: int) -> Column:
    return F.get(c, F.lit(at))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def position(c: Column, value: Column) -> Column:
    """First place, or -1."""
    return (F.array_position(c, value) - 1).cast("long")


def resize(c: Column, n: int, fill: Column) -> Column:
    return F.concat(F.slice(c, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(c), F.lit(0))))


def drop_repeats(c: Column) -> Column:
    """Without elements equal to the one before."""
    return F.filter(c, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(c, i - 1)))


def append_range(c: Column, lo: Column, hi: Column) -> Column:
    """Ranges (structs of lo and hi, in order and apart) with one more at the end; an error if it is empty or not above the last."""
    top = F.try_element_at(c, F.lit(-1))["hi"]
    fits = (lo <= hi) & (top.isNull() | (lo > top))
    more = F.concat(c, F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))
    return F.when(fits, more).otherwise(F.raise_error(F.lit("range out of order")).cast("array<struct<lo:int,hi:int>>"))

"""Dictionaries, adjacent duplicates, sections of lines and ordered unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.operators.manifest import running_before


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, code: 1, 2, ... by first appearance; null has no row and stands for 0.

    First appearances are aggregated before they are ranked, and ranks are
    built in two levels, so the order is never in one task.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    ranked = running_before(first, F.lit(1), "first", "code")
    return ranked.select(value, (F.col("code") + 1).alias("code"))


def encode(df: DataFrame, codes: DataFrame, value: str, name: str = "code") -> DataFrame:
    return df.join(codes.withColumnRenamed("code", name), value, "left").fillna(0, [name])


def decode(df: DataFrame, codes: DataFrame, code: str, value: str) -> DataFrame:
    return df.join(codes.select(F.col("code").alias(code), value), code, "left")


def drop_adjacent(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Rows whose value differs from the one before in the same group; nulls are equal."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lag(value).over(w))
    return marked.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_last"))).drop("_n", "_last")


def sections(lines: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """lines (by, n, line) outside start and end lines, with part 'before' or 'after'; lines inside and marker lines go."""
    w = Window.partitionBy(*by).orderBy("n")
    opened = F.sum((F.col("line") == start).cast("int")).over(w)
    closed = F.sum((F.col("line") == end).cast("int")).over(w)
    marked = lines.withColumn("_o", opened).withColumn("_c", closed)
    outside = (F.col("_o") == 0) | ((F.col("_c") > 0) & (F.col("line") != end))
    return marked.where(outside).withColumn("part", F.when(F.col("_o") == 0, "before").otherwise("after")).drop("_o", "_c")


def append(*frames: DataFrame) -> DataFrame:
    """Rows of all, duplicates kept, with the number of the frame."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("part", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def in_ranges(x: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code point lies in one of sorted ranges."""
    table = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ranges])
    return F.exists(table, lambda r: x.between(r["lo"], r["hi"]))


def any_in_ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether any character of a string lies in one of the ranges; by one regular expression."""
    return c.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]")


def join_ranges(df: DataFrame, value: str, ranges: DataFrame, width: int = 256) -> DataFrame:
    """Rows of df with each row of ranges (lo, hi, ...) that their value lies in.

    An equality join: a range stands under every block of `width` values that it touches.
    """
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    marked = df.withColumn("_block", F.floor(F.col(value) / width))
    return marked.join(blocks, "_block").where(F.col(value).between(F.col("lo"), F.col("hi"))).drop("_block")

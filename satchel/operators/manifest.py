"""Listings, layout and directories of tables of members."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.session import shared_dir


def path_of(parent: Column, name: Column) -> Column:
    return F.concat_ws("/", parent, name)


def compressed() -> Column:
    return F.coalesce(F.col("compression.algorithm") > 0, F.lit(False))


def logical_size() -> Column:
    """Size before compression."""
    return F.when(compressed(), F.col("compression.original_size")).otherwise(F.col("size"))


def flags() -> Column:
    """Four marks: directory, integrity, executable, unpacked or compressed."""
    mark = lambda c, x: F.when(c, x).otherwise("-")
    file = F.concat(F.lit("-"), mark(F.col("integrity.hash").isNotNull(), "i"), mark(F.col("executable"), "x"), F.when(F.col("unpacked"), "u").otherwise(mark(compressed(), "z")))
    return F.when(F.col("is_dir"), F.concat(F.lit("d--"), mark(F.col("unpacked"), "u"))).otherwise(file)


def short_line() -> Column:
    return F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))


def long_line() -> Column:
    """Marks, stored and original size, path; columns of fixed width that grow with the number."""
    wide = lambda c: F.when(F.length(c) < 12, F.lpad(c, 12, " ")).otherwise(c)
    left = lambda c: F.when(F.length(c) < 12, F.rpad(c, 12, " ")).otherwise(c)
    stored, original = F.col("size").cast("string"), F.col("compression.original_size").cast("string")
    sizes = F.when(F.col("is_dir"), F.repeat(F.lit(" "), 27)).when(compressed(), F.concat(F.lit("#"), left(stored), F.lit(" "), wide(original), F.lit(" "))).otherwise(F.concat(F.repeat(F.lit(" "), 14), wide(stored), F.lit(" ")))
    return F.concat(flags(), F.lit(" "), sizes, short_line())


def listing(members: DataFrame, verbose: bool = False) -> DataFrame:
    """archive_path, ordinal, line in document order."""
    return members.select("archive_path", "ordinal", (long_line() if verbose else short_line()).alias("line")).orderBy("archive_path", "ordinal")


def packed(members: DataFrame) -> DataFrame:
    """Files with content in the archive."""
    return members.where("not is_dir and not unpacked")


def running_before(df: DataFrame, value: Column, order: str, name: str, width: int = 1 << 16, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of value over all rows before each in the order of a whole number.

    Two levels, so that no task sees all rows: sums of stretches of `width`
    order values, a running sum over the stretches, and a window within each.
    """
    marked = df.withColumn("_stretch", F.floor(F.col(order) / width)).withColumn("_value", value)
    over = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*by, "_stretch").agg(F.sum("_value").alias("_total"))
    before = totals.select(*by, "_stretch", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(before, [*by, "_stretch"])
    return joined.withColumn(name, (F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0))).cast("long")).drop("_stretch", "_value", "_before")


def with_offsets(members: DataFrame, width: int = 1 << 16, by: tuple[str, ...] = ()) -> DataFrame:
    """offset: the stored sizes of packed files before this one; null for others."""
    holds = ~F.col("is_dir") & ~F.col("unpacked")
    laid = running_before(members.drop("offset"), F.when(holds, F.col("size")).otherwise(0), "ordinal", "offset", width, by)
    return laid.withColumn("offset", F.when(holds, F.col("offset")))


def dump_directory(members: DataFrame, width: int = 1 << 16) -> DataFrame:
    """name, size, alg, original_size, idx of packed files, by bytes of the path; idx counts in document order."""
    found = running_before(packed(members), F.lit(1), "ordinal", "idx", width)
    return found.select(
        F.col("path").alias("name"), "size", F.when(compressed(), 1).otherwise(0).alias("alg"), F.coalesce("compression.original_size", F.lit(0)).cast("long").alias("original_size"), "idx"
    ).orderBy("name")


def numbered(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """df with 0, 1, ... in an order. The rows are sorted by ranges into a table of the shared folder, and
    numbers begin with the count of rows in the parts before: no task sees more than its range."""
    placed = df.drop(name).orderBy(*order)
    # A row's number within its part is the low 33 bits.
    marked = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))
    path = f"{shared_dir(df.sparkSession)}/satchel-{uuid.uuid4().hex}"
    marked.write.parquet(path)
    table = df.sparkSession.read.schema(marked.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return table.join(F.broadcast(parts), "_part").withColumn(name, F.col("_first") + F.col("_nth")).drop("_part", "_nth", "_first")  # a row a partition


def preorder(members: DataFrame) -> DataFrame:
    """members with ordinal in the order of path segments, a directory before what it holds."""
    return numbered(members, F.split("path", "/"))


def with_defaults(members: DataFrame) -> DataFrame:
    """Attributes that an entry does not state: size and offset 0, not executable, not unpacked."""
    values = {"size": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "executable": F.lit(False), "unpacked": F.lit(False)}
    return members.withColumns({c: F.coalesce(c, v) if c in members.columns else v for c, v in values.items()})


def children(members: DataFrame) -> DataFrame:
    """parent, child paths."""
    child = members.select(F.col("parent_path").alias("parent"), F.col("path").alias("child"))
    return members.where("is_dir").select(F.col("path").alias("parent")).join(child, "parent")


def under(members: DataFrame, roots: DataFrame, anti: bool = False) -> DataFrame:
    """Members that are, or lie below, a path of roots (path); anti: the others.

    An equality join over exploded ancestors; only paths are shuffled.
    """
    from satchel.operators.patterns import ancestors

    reached = members.select("path", F.explode(ancestors(F.col("path"))).alias("_a")).join(roots.select(F.col("path").alias("_a")).distinct(), "_a", "left_semi").select("path").distinct()
    return members.join(reached, "path", "left_anti" if anti else "left_semi")

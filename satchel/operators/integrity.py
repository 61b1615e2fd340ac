"""Whole-file and block hashes, and their verification."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.schema import BLOCK


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def block_digests(content: Column, block: int = BLOCK) -> Column:
    """A digest for each block and one for the end, so floor(size / block) + 1 of them; the last may be of nothing."""
    n = F.floor(F.octet_length(content) / block).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: digest(F.substring(content, k * block + 1, block)))


def protect(members: DataFrame, content: str = "content", block: int = BLOCK) -> DataFrame:
    """members with integrity of their content; null content has none."""
    made = F.struct(F.lit(1).alias("algorithm"), digest(F.col(content)).alias("hash"), F.lit(block).cast("long").alias("block_size"), block_digests(F.col(content), block).alias("blocks"))
    return members.withColumn("integrity", F.when(F.col(content).isNotNull(), made))


def verify(members: DataFrame, content: str = "content", block: int = BLOCK) -> DataFrame:
    """members with hash_ok and bad_blocks, null if there is nothing to compare.

    Blocks that the content has are compared; stored ones beyond are not, and a
    missing stored block is no error.
    """
    stored = F.col("integrity.blocks")
    n = F.ceil(F.octet_length(F.col(content)) / block).cast("int")
    have = F.slice(block_digests(F.col(content), block), 1, F.greatest(n, F.lit(0)))
    bad = F.size(F.filter(F.arrays_zip(have.alias("a"), F.slice(stored, 1, F.greatest(n, F.lit(0))).alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"])))
    return members.withColumn("hash_ok", F.when(F.col("integrity.hash").isNotNull() & F.col(content).isNotNull(), F.col("integrity.hash") == digest(F.col(content)))).withColumn(
        "bad_blocks", F.when(stored.isNotNull() & F.col(content).isNotNull(), bad)
    )


def report(verified: DataFrame) -> DataFrame:
    """One row: members, checked, errors (whole-file hashes that differ), bad_blocks, wrong_size."""
    return verified.agg(
        F.count("*").alias("members"),
        F.count_if(F.col("hash_ok").isNotNull()).alias("checked"),
        F.count_if(~F.col("hash_ok")).alias("errors"),
        F.coalesce(F.sum("bad_blocks"), F.lit(0)).cast("long").alias("bad_blocks"),
        F.count_if(F.octet_length("content") != F.coalesce("compression.original_size", "size")).alias("wrong_size"),
    )


def digest_of_parts(parts: DataFrame, by: str, order: str = "block", content: str = "content") -> DataFrame:
    """by, digest: of each file's parts in their order, which are never one value; a task holds the parts of one file."""

    def run(table: pa.Table) -> pa.Table:
        h = hashlib.sha256()
        for chunk in table.sort_by(order)[content].chunks:
            for part in chunk:
                h.update(memoryview(part.as_buffer()) if part.is_valid else b"")
        return pa.table({by: table[by].slice(0, 1), "digest": pa.array([h.digest()], pa.binary())})

    kind = parts.schema[by].dataType.simpleString()
    return parts.select(by, order, content).groupBy(by).applyInArrow(run, f"{by} {kind}, digest binary")

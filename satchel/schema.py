"""Columns of a table of members.

Sizes are unsigned 64-bit words in archives. Readers refuse those of 2**63 and
more, so that a long holds them and sums stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import types as T

INTEGRITY = T.StructType([
    T.StructField("algorithm", T.IntegerType()),
    T.StructField("hash", T.BinaryType()),
    T.StructField("block_size", T.LongType()),
    T.StructField("blocks", T.ArrayType(T.BinaryType())),
])
COMPRESSION = T.StructType([T.StructField("algorithm", T.IntegerType()), T.StructField("original_size", T.LongType())])

MEMBER = T.StructType([
    T.StructField("archive_path", T.StringType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("parent_path", T.StringType()),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("offset", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("executable", T.BooleanType(), False),
    T.StructField("unpacked", T.BooleanType(), False),
    T.StructField("integrity", INTEGRITY),
    T.StructField("compression", COMPRESSION),
])
WITH_CONTENT = T.StructType([*MEMBER.fields, T.StructField("content", T.BinaryType())])

# Fixed values of the formats.
BLOCK = 4 * 1024 * 1024
SHA256, DEFLATE = 1, 1

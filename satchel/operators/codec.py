"""Raw DEFLATE over Arrow batches. The built-in functions have no such codec."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def deflate_bytes(data: bytes, level: int = 9) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 9)
    return z.compress(data) + z.flush()


def inflate_bytes(data: bytes) -> bytes:
    z = zlib.decompressobj(-15)
    out = z.decompress(data) + z.flush()
    if not z.eof:
        raise ValueError("DEFLATE data end early")
    return out


def deflate(content: Column, level: int = 9) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else deflate_bytes(bytes(b), level))

    return run(content)


def inflate(content: Column) -> Column:
    """Null for data that are no complete stream."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> bytes | None:
            try:
                return None if b is None else inflate_bytes(bytes(b))
            except (zlib.error, ValueError):
                return None

        return s.map(one)

    return run(content)


def ratio() -> Column:
    return F.col("size") / F.col("compression.original_size")


def smallest_deflate(content: Column, tries: int = 15) -> Column:
    """Raw DEFLATE at the cost of time: the shortest of up to `tries` settings of the encoder, the default ones first."""
    settings = [(9, 9, zlib.Z_DEFAULT_STRATEGY), *((level, memory, s) for s in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_RLE, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED) for level in (9, 7, 5) for memory in (9, 8, 6))]
    settings = list(dict.fromkeys(settings))[: max(1, tries)]

    def one(data: bytes) -> bytes:
        best = None
        for level, memory, strategy in settings:
            z = zlib.compressobj(level, zlib.DEFLATED, -15, memory, strategy)
            out = z.compress(data) + z.flush()
            best = out if best is None or len(out) < len(best) else best
        return best

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else one(bytes(b)))

    return run(content)


def deflate_bound(n: Column) -> Column:
    """Bytes that n bytes take at most once compressed: a tenth more, or five for each block of 31 KiB, and 128."""
    return F.greatest(F.floor(n * 110 / 100), n + (F.floor(n / (31 * 1024)) + 1) * 5) + 128

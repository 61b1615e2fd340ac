"""Hex, words and number layouts. What built-in functions cannot lay out runs over Arrow batches."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c))


def hex_decode(c: Column) -> Column:
    """Either case; ASCII white space and - between digits are skipped; null for an odd count or another character."""
    digits = F.regexp_replace(F.regexp_extract(c, '^[^"\\x00]*', 0), "[\\t\\n\\f\\r -]", "")
    return F.when(F.length(digits) % 2 == 0, F.unhex(digits))


def word_le(c: Column, at: int = 0) -> Column:
    """Unsigned little-endian 32-bit word at byte at."""
    return F.conv(F.concat(*[F.hex(F.substring(c, at + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")


def pack_word_le(c: Column) -> Column:
    """A long below 2**32 as four bytes."""
    h = F.lpad(F.hex(c), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def utf16(c: Column) -> Column:
    return F.encode(c, "UTF-16LE")


def utf32(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.encode("utf-32-le"))

    return run(c)


def from_code_point(c: Column) -> Column:
    """The character of a code point; null for one that has none."""
    n = c.cast("long")
    part = lambda shift, top: F.lpad(F.hex(F.shiftright(n, shift).bitwiseAND(F.lit(63 if top == 128 else 255)).bitwiseOR(F.lit(top))), 2, "0")
    made = (
        F.when(n < 0x80, F.lpad(F.hex(n), 2, "0"))
        .when(n < 0x800, F.concat(part(6, 0xC0), part(0, 128)))
        .when(n < 0x10000, F.concat(part(12, 0xE0), part(6, 128), part(0, 128)))
        .otherwise(F.concat(part(18, 0xF0), part(12, 128), part(6, 128), part(0, 128)))
    )
    return F.when(((n >= 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000)), F.decode(F.unhex(made), "UTF-8"))


def _series(kind: str, one) -> object:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x is pd.NA else one(x))

    # A null number arrives as NaN.
    return lambda c: F.when(c.isNotNull(), run(c))


def double_bits(c: Column) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(np.float64).view(np.int64)).where(s.notna())

    return run(c)


def double_of_bits(c: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(np.int64).view(np.float64))

    return run(c)


def float_bits(c: Column) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(np.float32).view(np.int32))

    return run(c)


def hex_double(c: Column) -> Column:
    """Exact: 0x1.<13 digits>p<exponent>."""
    return _series("string", lambda x: float(x).hex())(c)


def double_of_hex(c: Column) -> Column:
    def one(x: str) -> float | None:
        try:
            return float.fromhex(x) if re.match(r"\s*[-+]?0[xX]", x) else None
        except (ValueError, OverflowError):
            return None

    return _series("double", one)(c)


def shortest_17(c: Column) -> Column:
    """%.17g; +nan, +inf and -inf."""

    def one(x: float) -> str:
        if x != x:
            return "+nan"
        return ("+inf" if x > 0 else "-inf") if x in (float("inf"), float("-inf")) else "%.17g" % x

    return _series("string", one)(c)


def pack(layout: str, *cols: Column) -> Column:
    """Little-endian bytes of numbers, by letters of the struct module; @ before a letter aligns it with zeros."""
    letters = re.findall(r"@?[bBhHiIqQfd]", layout)
    plain = ""
    size = 0
    for x in letters:
        n = struct.calcsize("<" + x[-1])
        if x[0] == "@":
            gap = -size % n
            plain += "x" * gap
            size += gap
        plain += x[-1]
        size += n

    @F.pandas_udf("binary")
    def run(*s: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else struct.pack("<" + plain, *(v if x[-1] in "fd" else int(v) for v, x in zip(row, letters, strict=True))) for row in zip(*s, strict=True)])

    return run(*cols)


_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "'": 39, "\\": 92, "?": 63}  # fixed values
_escape = re.compile(r"\\(?:([abtnvfr\"'\\?])|x([0-9a-fA-F]+)|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{1,3}))")


def unescape(c: Column) -> Column:
    """C99 escapes of characters."""

    def put(m: re.Match) -> str:
        n = _ESCAPES[m[1]] if m[1] else int(m[2] or m[3] or m[4] or m[5], 8 if m[5] else 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"

    return _series("string", lambda x: _escape.sub(put, x))(c)


def shell_quote(c: Column) -> Column:
    from shlex import quote

    return _series("string", quote)(c)


def float_of_bits(c: Column) -> Column:
    @F.pandas_udf("float")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(np.int32).view(np.float32))

    return run(c)


def hex_float(c: Column) -> Column:
    """Exact: 0x1.<6 digits>p<exponent>, where the 23 bits of the fraction stand shifted by one."""

    def one(x: float) -> str:
        bits = int(np.float32(x).view(np.uint32))
        sign, exponent, fraction = "-" if bits >> 31 else "", bits >> 23 & 255, bits & 0x7FFFFF
        if exponent == 255:
            return (sign or "+") + ("nan" if fraction else "inf")
        power = exponent - 127 if exponent else (-126 if fraction else 0)
        return f"{sign}0x{int(exponent > 0)}.{fraction << 1:06x}p{power:+d}"

    return _series("string", one)(c)


_hex_float = re.compile(r"([-+]?)(?:(inf)|(nan)|0x([01])\.([0-9a-fA-F]{6})p([-+][0-9]+))")


def float_of_hex(c: Column) -> Column:
    """What hex_float() writes; null for anything else."""

    def one(x: str) -> float | None:
        m = _hex_float.fullmatch(x)
        if not m:
            return None
        sign = -1.0 if m[1] == "-" else 1.0
        if m[2] or m[3]:
            return sign * float(m[2] or m[3])
        exponent = int(m[6]) + 127 if m[4] == "1" else 0
        if not 0 <= exponent <= 254:
            return None
        return float(np.uint32((m[1] == "-") << 31 | exponent << 23 | int(m[5], 16) >> 1).view(np.float32))

    # A NaN from a series would become null.
    return F.when(c.rlike("^[-+]?nan$"), F.lit(float("nan")).cast("float")).otherwise(_series("float", one)(c))


def _byte(c: Column, at: Column) -> Column:
    """Byte at a place from 0 as a number; 0 beyond the end."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substr(c, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))


def is_lead(byte: Column) -> Column:
    """Whether a byte begins a UTF-8 sequence of several."""
    return byte.bitwiseAND(F.lit(0xC0)) == 0xC0


def is_tail(byte: Column) -> Column:
    """Whether a byte continues a UTF-8 sequence."""
    return byte.bitwiseAND(F.lit(0xC0)) == 0x80


def is_wide(byte: Column) -> Column:
    """Whether a byte is part of a UTF-8 sequence of several."""
    return byte.bitwiseAND(F.lit(0x80)) == 0x80


def byte_counts(c: Column) -> Column:
    """lead, tail and plain: how many bytes of each class a binary holds."""
    chars = F.decode(c, "ISO-8859-1")  # a character a byte
    count = lambda a, b: F.regexp_count(chars, F.lit(f"[\\x{{{a:02X}}}-\\x{{{b:02X}}}]")).cast("long")
    lead, tail = count(0xC0, 0xFF), count(0x80, 0xBF)
    return F.struct(lead.alias("lead"), tail.alias("tail"), (F.octet_length(c) - lead - tail).alias("plain"))


def first_code_point(c: Column, at: Column | None = None) -> Column:
    """code and used (bytes) of the UTF-8 sequence at a place, without checks: its length is taken from the
    first byte alone and six bits from each byte after it. A byte that continues a sequence gives 0 and uses none."""
    at = F.lit(0) if at is None else at
    b = [_byte(c, at + k) for k in range(4)]
    six = lambda k, shift: F.shiftleft(b[k].bitwiseAND(F.lit(0x3F)), shift)
    top = lambda mask, shift: F.shiftleft(b[0].bitwiseAND(F.lit(mask)), shift)
    used = F.when(b[0] < 0x80, 1).when(b[0] < 0xC0, 0).when(b[0] < 0xE0, 2).when(b[0] < 0xF0, 3).otherwise(4)
    code = F.when(used == 1, b[0]).when(used == 0, 0).when(used == 2, top(0x1F, 6) + six(1, 0)).when(used == 3, top(0x0F, 12) + six(1, 6) + six(2, 0)).otherwise(top(0x07, 18) + six(1, 12) + six(2, 6) + six(3, 0))
    return F.struct(code.alias("code"), used.alias("used"))


def from_utf16(c: Column, replace: bool = True) -> Column:
    """Text of UTF-16LE bytes; broken ones become U+FFFD, or the result null."""
    return _series("string", lambda b: _decoded(b, "utf-16-le", replace))(c)


def from_utf32(c: Column, replace: bool = True) -> Column:
    return _series("string", lambda b: _decoded(b, "utf-32-le", replace))(c)


def _decoded(b: bytes, kind: str, replace: bool) -> str | None:
    try:
        return bytes(b).decode(kind, "replace" if replace else "strict")
    except UnicodeDecodeError:
        return None

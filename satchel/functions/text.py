"""String functions as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^\\x{FEFF}", "")


def trim(c: Column) -> Column:
    """On the left any code up to a space goes, on the right ASCII white space."""
    return F.regexp_replace(c, "^[\\x01-\\x20]+|[ \\t-\\r]+$", "")


def trim_left(c: Column) -> Column:
    return F.regexp_replace(c, "^[ \\t-\\r]+", "")


def trim_right(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t-\\r]+$", "")


def normalize(c: Column) -> Column:
    """Runs of codes up to a space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, "[\\x01-\\x20]+", " "))


def translate(c: Column, old: str, new: str) -> Column:
    return F.translate(c, old, new)


def count_char(c: Column, char: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("long")


def tokens(c: Column, separators: str) -> Column:
    """Parts between runs of separators, none empty."""
    body = "".join("\\" + s if not s.isalnum() else s for s in separators)
    return F.filter(F.split(c, f"[{body}]+"), lambda x: x != "")


def insert(c: Column, at: int, part: str) -> Column:
    """part put before position at, from 0."""
    return F.overlay(c, F.lit(part), F.lit(at + 1), F.lit(0))


def equal(a: Column, b: Column) -> Column:
    """Nulls are equal."""
    return a.eqNullSafe(b)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def equal_ignoring_case(a: Column, b: Column) -> Column:
    """ASCII case; all characters count, the last one too."""
    return F.translate(a, _UPPER, _LOWER).eqNullSafe(F.translate(b, _UPPER, _LOWER))


def after_prefix(c: Column, prefix: str) -> Column:
    """What follows the prefix, or null."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30))


def suffix_start(c: Column, suffix: str) -> Column:
    """Where the suffix starts, from 0, or null."""
    return F.when(F.endswith(c, F.lit(suffix)), F.length(c) - len(suffix))


def code_point(c: Column) -> Column:
    """Of the first character; null for an empty string."""
    return F.when(F.length(c) > 0, F.ascii(c))


def hex_int(c: Column) -> Column:
    return F.lower(F.hex(c))


_directive = re.compile(r"%(%|s|c|lc|wc|d|x|t|u|z|g|ld|lu|lld|llu|lx)")


def printf(template: str, *args: Column) -> Column:
    """%% s c lc wc d x t u z g and ld lu lx lld llu; no widths. c, lc and wc take code points, u, z and their
    long forms count a negative number as 64 bits without a sign, g has 17 digits."""
    from satchel.functions.binary import from_code_point, shortest_17

    out, given, at = [], iter(args), 0
    for m in _directive.finditer(template):
        if "%" in template[at : m.start()]:
            break
        out.append(F.lit(template[at : m.start()]))
        at, kind = m.end(), m[1]
        if kind == "%":
            out.append(F.lit("%"))
            continue
        c = next(given)
        if kind in ("c", "lc", "wc"):
            out.append(from_code_point(c))
        elif kind in ("x", "lx"):
            out.append(hex_int(c))
        elif kind == "g":
            out.append(shortest_17(c.cast("double")))
        elif kind in ("u", "z", "lu", "llu"):
            n = c.cast("decimal(20,0)")
            out.append(F.when(n < 0, n + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(n).cast("decimal(20,0)").cast("string"))
        else:
            out.append(c.cast("string"))
    if "%" in template[at:]:
        raise ValueError(f"unknown directive in {template!r}")
    return F.concat(*out, F.lit(template[at:]))


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def lines(c: Column) -> Column:
    """Lines without their ends, \\n or \\r\\n; what follows the last end is a line if it is not empty."""
    every = F.split(c, "\n")
    ended = F.when(F.endswith(c, F.lit("\n")) | (c == ""), F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    return F.transform(ended, lambda x: F.regexp_replace(x, "\r$", ""))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points; null comes before every string."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)


def concat_all(*parts: Column) -> Column:
    return reduce(F.concat, parts)

"""Path functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.functions.text import tokens


def basename(c: Column) -> Column:
    """After the last slash, backslash or colon."""
    return F.regexp_extract(c, "([^/\\\\:]*)$", 1)


def dirname(c: Column) -> Column:
    """Up to and with the last slash."""
    return F.regexp_extract(c, "^(.*/)?", 0)


def stem(c: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(c), "\\.[^.]*$", "")


def extension(c: Column) -> Column:
    """From the last point of the name on; empty without one."""
    return F.regexp_extract(basename(c), "(\\.[^.]*)$", 1)


def last_dir(c: Column) -> Column:
    """The last component, a slash at the end aside."""
    return F.regexp_extract(c, "([^/]+)/?$", 1)


def root(c: Column) -> Column:
    return F.regexp_extract(c, "^(/?)", 1)


def relative(c: Column) -> Column:
    return F.regexp_replace(c, "^/+", "")


def valid(c: Column) -> Column:
    """A path with a tilde is not taken."""
    return ~F.contains(c, F.lit("~"))


def safe(c: Column) -> Column:
    """Whether extraction may use it: relative, and no component is '..'."""
    return (c != "") & ~F.startswith(c, F.lit("/")) & ~F.array_contains(F.split(c, "/"), "..") & ~F.contains(c, F.lit("\x00"))


def trim_separator(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=.)/$", "")


def with_separator(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("/")), c).otherwise(F.concat(c, F.lit("/")))


def segments(c: Column) -> Column:
    return tokens(c, "/")


def stored_root(c: Column) -> Column:
    """The name under which a created archive keeps an argument: its last component, empty after a final slash."""
    return F.substring_index(c, "/", -1)

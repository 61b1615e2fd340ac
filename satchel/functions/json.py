"""JSON values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(c: Column, path: str, kind: str = "string") -> Column:
    """Value at a path such as $.a.b, null if absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def keys(c: Column) -> Column:
    """Of an object, in its order, repeats kept."""
    return F.json_object_keys(c)


def kind(c: Column, path: str = "$") -> Column:
    """object, array, string, number, boolean, null or absent."""
    v = F.try_parse_json(c)
    t = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return (
        F.when(t.isNull(), "absent")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", "null")
        .otherwise("number")
    )


def put(**fields: Column) -> Column:
    """An object with the fields in order; nulls stay out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def member_json() -> Column:
    """The attributes of a member as an archive directory writes them."""
    integrity = F.when(F.col("integrity.algorithm") == 1, F.struct(
        F.lit("SHA256").alias("algorithm"), F.lower(F.hex("integrity.hash")).alias("hash"), F.col("integrity.block_size").alias("blockSize"),
        F.transform("integrity.blocks", lambda b: F.lower(F.hex(b))).alias("blocks")))
    compression = F.when(F.col("compression.algorithm") == 1, F.struct(F.lit("DEFLATE").alias("algorithm"), F.col("compression.original_size").alias("originalSize")))
    only = lambda c: F.when(c, F.lit(True))
    return put(
        size=F.col("size"), unpacked=only(F.col("unpacked")), offset=F.when(~F.col("unpacked"), F.col("offset").cast("string")),
        executable=only(F.col("executable")), integrity=integrity, compression=compression,
    )


def valid(c: Column) -> Column:
    """Whether a string is one JSON value; null for null. The other functions give null for what is not."""
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())


def elements(c: Column, path: str = "$", kind: str = "string") -> Column:
    """Elements of the array at a path; null if there is none or an element is of another kind."""
    return F.try_variant_get(F.try_parse_json(c), path, f"array<{kind}>")


def put_array(*values: Column) -> Column:
    """An array of the values in order, null as null."""
    return F.to_json(F.array(*values), {"ignoreNullFields": "false"})


def indented(c: Column) -> Column:
    """The same value with a line for each element or field, one space deeper a level; null if it is no JSON."""
    import json

    from satchel.functions.binary import _series

    def one(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), indent=1, ensure_ascii=False)
        except ValueError:
            return None

    return _series("string", one)(c)

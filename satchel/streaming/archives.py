"""New archives in a folder as a stream of members. An extension: archivers know no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from satchel.schema import MEMBER
from satchel.sources.archive import open_bytes


def members(spark: SparkSession, folder: str, glob: str = "*.[ab]sar", per_trigger: int = 100) -> DataFrame:
    """A row for each member of each archive that appears in folder. Archives are read whole, so each must be below 2 GB."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(MEMBER)
        names = [f.name for f in MEMBER.fields]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [dict(zip(names, e.row(path), strict=True)) for e in open_bytes(data.as_py())[0]]
                for r in rows:
                    i, c = r["integrity"], r["compression"]
                    r["integrity"] = i and dict(zip(("algorithm", "hash", "block_size", "blocks"), i, strict=True))
                    r["compression"] = c and dict(zip(("algorithm", "original_size"), c, strict=True))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, MEMBER)

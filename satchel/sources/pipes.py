"""Bytes through the standard input and output of a command, and tables of given strings."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def through(df: DataFrame, command: list[str], content: str = "content", seconds: float = 600) -> DataFrame:
    """df with each value of a binary column replaced by what a command writes when it reads the value.

    The command must exist on every executor; it runs without a shell, once a
    row. A status other than 0 is an error. Null stays null.
    """
    at = df.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if v is None else subprocess.run(command, input=v, stdout=subprocess.PIPE, check=True, timeout=seconds).stdout for v in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def output_lines(spark: SparkSession, commands: Iterable[list[str]], seconds: float = 600) -> DataFrame:
    """command (its place), line, text: what each of some commands writes, a task a command."""
    listed = list(commands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                text = subprocess.run(listed[k], stdout=subprocess.PIPE, stdin=subprocess.DEVNULL, check=True, timeout=seconds).stdout.decode("utf-8", "replace").splitlines()
                yield pa.record_batch([pa.array([k] * len(text), pa.int64()), pa.array(range(len(text)), pa.int64()), pa.array(text, pa.string())], ["command", "line", "text"])

    return spark.range(0, len(listed), 1, max(1, len(listed))).mapInArrow(run, "command long, line long, text string")


def strings(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """ordinal, content: given strings as UTF-8, or an empty table of the same columns."""
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ordinal long, text string").select("ordinal", F.encode("text", "UTF-8").alias("content"))

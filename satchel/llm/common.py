"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.session import shared_dir, ship

#: A word is a run of characters other than ASCII white space. bytes.split()
#: without an argument cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor
    costs no recomputation and later plans start from a table."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/satchel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._satchel_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._satchel_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_caches: list[dict] = []


def forgets(cache: dict) -> None:
    """From now on tidy() empties cache."""
    _caches.append(cache)


def tidy() -> None:
    """Gives memory of a reused Python worker back: caches of words and pieces, Arrow's pool and the C heap."""
    for cache in _caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(run: Callable) -> Callable:
    """run, then tidy()."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """each over the Arrow batches of df, a thousand rows at a time to hold few texts and results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                yield each(b.slice(i, 1000))

    return df.mapInArrow(tidied(run), schema)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text without a copy through str; null gives b''."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def held_out(doc_id: Column, of: int) -> Column:
    """True if the remainder of crc32(doc_id as text) is 0; a null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == 0, F.lit(False))


class WordHash(dict):
    """XXH64 by word, remembered for the words met last in a task."""

    MOST = 150_000

    def __init__(self) -> None:
        super().__init__()
        forgets(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by randomised contraction.

    edges: (a, b) of any orderable type. Returns (node, root), one row for
    each node of an edge; root is a node of the same component. In each round
    every node hooks to the neighbour (or itself) whose salted hash is least,
    and edges are rewritten between the chosen nodes. With a new salt each
    round the number of live nodes falls by a constant factor in expectation,
    whatever the shape (stars and long chains alike). Only aggregates by node
    are shuffled, combined on the map side first, so that a hub costs one row
    a task.
    """
    spark = edges.sparkSession
    live = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    hooks: list[DataFrame] = []
    for k in range(most_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        hook = stored(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["to"].alias("root")))
        hooks.append(hook)
        left = live.join(hook.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(hook.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        before, live = live, stored(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(before)
    else:
        if not live.isEmpty():
            raise RuntimeError("components: rounds exhausted")
    if not hooks:
        kind = edges.schema["a"].dataType.simpleString()
        # Rows from a Python list would start a second Python daemon on every executor.
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c in ("node", "root")))
    # The nodes of a later round are roots of the round before.
    out = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = hook.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out

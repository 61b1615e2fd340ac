"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes nearest Euclidean neighbour: with M the largest
norm, x goes to (x / M, sqrt(1 - |x|^2 / M^2)) and a query to (q / |q|, 0). In
each of TABLES tables k Gaussian projections, shifted and cut into cells of
width w, give a bucket. All these are unit vectors, so a neighbour at distance
r is c q + s u with c = 1 - r^2 / 2, s^2 = 1 - c^2 and u a unit vector across
q: its projection is normal around c times the query's with deviation s. The
chance that it lies in a bucket is thus a product of k normal intervals, and so
is the chance of any vector. A query visits buckets in the order of their
estimated success for each row that a visit costs, the ratio of both chances,
until the chances of a neighbour add up to what the recall needs. Buckets are
enumerated down to a chance of LEAST, so at most 1 / LEAST of them; a query
that needs more looks at every row. Candidates of all tables are ranked by the
exact inner product of the original vectors.

Equal vectors are one class, of which the least ids are kept as far as an
answer can need them; every row is indexed. A shard holds buckets by hash;
buckets of more than 1/64 of the rows (a bounded list) are spread over all
shards. Queries stream past the vectors of a shard, so neither their number
nor a hot bucket is held in memory. The distance r is each query's own, to its
RESULTS-th neighbour among SAMPLE rows (broadcast), ranks scaled, since dense
and sparse neighbourhoods differ; the width takes the mean over PROBED queries.
k grows with the logarithm of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import stored, tidied

RESULTS = 20
EVERY = 20  # queries are the ids that it divides
TABLES = 4
TARGET = 0.94  # chance that one table or another finds a neighbour at the query's distance r
LEAST = 1e-5  # chance of the last bucket that is enumerated
EVERYTHING = np.iinfo(np.int64).min  # stands for all buckets of a table
SAMPLE, PROBED = 20_000, 256
SHARD = 32_768  # index rows
SEED = 42

_erf = np.vectorize(math.erf, otypes=[float])


@dataclass
class Hashing:
    norm: float  # M
    width: float
    a: np.ndarray  # tables x k x (d + 1)
    b: np.ndarray  # tables x k
    mult: np.ndarray  # k odd multipliers that fold a bucket to 64 bits

    @classmethod
    def make(cls, rows: int, d: int, norm: float, r: float) -> Hashing:
        k = max(4, round(0.64 * math.log2(max(rows, 2))))
        rng = np.random.default_rng(SEED)
        width = 2.5 * r
        return cls(norm, width, rng.normal(size=(TABLES, k, d + 1)), rng.uniform(0, width, (TABLES, k)), rng.integers(0, 1 << 63, k, dtype=np.uint64) | np.uint64(1))

    def fold(self, table: int, cells: np.ndarray) -> np.ndarray:
        x = (cells.astype(np.int64).view(np.uint64) * self.mult).sum(-1, dtype=np.uint64) + np.uint64(table)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """tables x n buckets of rows."""
        lift = np.sqrt(np.maximum(0, 1 - (x**2).sum(1) / self.norm**2))
        v = np.concatenate([x / self.norm, lift[:, None]], 1)
        return np.stack([self.fold(t, np.floor((v @ self.a[t].T + self.b[t]) / self.width)) for t in range(len(self.a))])

    def probes(self, q: np.ndarray, r: float) -> list[np.ndarray]:
        """Buckets of one query, with neighbours at distance r, in each table, the most rewarding first; EVERYTHING alone if they are too many."""
        v = np.append(q / np.linalg.norm(q), 0.0)
        cosine = 1 - r**2 / 2
        spread = math.sqrt(max(1 - cosine**2, 1e-6))
        each = 1 - (1 - TARGET) ** (1 / len(self.a))
        out = []
        for t in range(len(self.a)):
            p = cosine * (self.a[t] @ v) + self.b[t]
            base = np.floor(p / self.width)
            steps = np.arange(-3, 5)
            edge = ((base[:, None] + steps) * self.width - p[:, None]) / spread
            cdf = 0.5 * (1 + _erf(edge / math.sqrt(2)))
            chance = np.diff(cdf, axis=1)  # k x 7 neighbouring cells
            plain = np.diff(0.5 * (1 + _erf((edge * spread + p[:, None] - self.b[t][:, None]) / math.sqrt(2))), axis=1)
            gain = np.log(np.maximum(chance, 1e-300)) - np.log(np.maximum(plain, 1e-300))
            least = 1e-3
            while True:
                total, won, cells = np.ones(1), np.zeros(1), np.zeros((1, 0))
                for j in range(len(p)):
                    # The best that the other projections can still give.
                    rest = chance[j + 1 :].max(1).prod()
                    i, c = np.nonzero(total[:, None] * chance[j] * rest >= least)
                    total, won, cells = total[i] * chance[j, c], won[i] + gain[j, c], np.concatenate([cells[i], (base[j] + steps[c])[:, None]], 1)
                if total.sum() >= (1 + each) / 2 or least <= LEAST:
                    break
                least = max(least / 4, LEAST)
            if total.sum() < each:
                return [np.array([EVERYTHING], np.int64)]
            order = np.argsort(-won, kind="stable")
            stop = int(np.searchsorted(np.cumsum(total[order]), each)) + 1
            out.append(self.fold(t, cells[order[:stop]]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(asked: np.ndarray, rows: np.ndarray, norm: float, rank: int) -> np.ndarray:
    """Of each query to its rank-th nearest of the rows."""
    out = np.empty(len(asked))
    for i in range(0, len(asked), 64):
        q = asked[i : i + 64]
        cosine = np.partition(q @ rows.T, len(rows) - rank, axis=1)[:, len(rows) - rank] / (np.linalg.norm(q, axis=1) * norm)
        out[i : i + 64] = np.sqrt(np.maximum(2 - 2 * cosine, 1e-6))
    return out


def _fit(classes: DataFrame, every: int, results: int) -> tuple[Hashing, int, np.ndarray, int] | None:
    """Hashing, number of classes, sample and the rank of a query's last neighbour in it."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    size = classes.agg(F.count("*").alias("n"), F.max(norm2).alias("m"), F.first(F.size("v")).alias("d")).first()
    if not size.n:
        return None
    norm = math.sqrt(size.m)
    draw = F.xxhash64("id")
    rows = _matrix(classes.orderBy(draw, "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks())
    asked = _matrix(classes.where("n_queries > 0").orderBy(draw, "id").limit(PROBED).select("v").toArrow()["v"].combine_chunks())
    if not len(asked):
        return None
    rank = min(len(rows), 1 + max(1, round(results * len(rows) / size.n)))  # the first is mostly the query itself
    r = float(_distances(asked, rows, norm, rank).mean())
    return Hashing.make(size.n, rows.shape[1], norm, r), size.n, rows, rank


def classes_of(vectors: DataFrame, every: int = EVERY, results: int = RESULTS) -> DataFrame:
    """id (least vec_id), v, ids (the results + 1 least vec_ids), n_queries, a row for each distinct usable vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    src = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = src.where(fine).distinct()
    common = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    src = src.join(F.broadcast(common), F.size("v") == F.col("d"), "left_semi")
    first = src.select("v", "vec_id", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")).alias("k")).where(F.col("k") <= results + 1)
    ids = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = src.groupBy("v").agg(F.sum((F.col("vec_id") % every == 0).cast("long")).alias("n_queries"))
    return ids.join(asked, "v").select(F.col("ids")[0].alias("id"), "v", "ids", "n_queries")


ROUTED = "shard int, kind int, id long, v array<double>, cells array<long>"


def _routed(classes: DataFrame, hashing: Hashing, shards: int, hot: np.ndarray, distances: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """Index rows (kind 0, one a table) or, given their distances, queries (kind 1, one a shard that they visit)."""
    queries = distances is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            if not queries:
                for row in hashing.buckets(x):
                    to = np.where(np.isin(row, hot), ids % shards, (row.view(np.uint64) % np.uint64(shards)).astype(np.int64))
                    yield cells_of(to, ids, x, row[:, None])
                continue
            for i, r in enumerate(distances(x).tolist()):
                cell = np.concatenate(hashing.probes(x[i], r))
                to = (cell.view(np.uint64) % np.uint64(shards)).astype(np.int64)
                warm = np.isin(cell, hot) | (cell == EVERYTHING)
                where = np.arange(shards) if warm.any() else np.unique(to)
                yield cells_of(where, np.full(len(where), ids[i]), np.repeat(x[i : i + 1], len(where), 0), [cell[(to == s) | warm] for s in where.tolist()])

    def cells_of(shard: np.ndarray, ids: np.ndarray, x: np.ndarray, cells: list) -> pa.RecordBatch:
        v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells)))
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(np.full(len(ids), int(queries), np.int32)), pa.array(ids), v, flat], ["shard", "kind", "id", "v", "cells"])

    return classes.select("id", "v").mapInArrow(tidied(run), ROUTED)


def _search(routed: DataFrame, top: int, norm: float) -> DataFrame:
    """(query, id, score): the best of the probed buckets in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for b in batches:
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(shards)], strict=True):
                if hi <= lo:
                    continue
                part = b.slice(lo, hi - lo)
                if shards[lo] != shard:
                    shard, parts, index = shards[lo], [], None
                if kinds[lo] == 0:
                    parts.append(part)
                    continue
                if index is None:
                    if not parts:
                        continue
                    cell = np.concatenate([p.column(4).flatten().to_numpy() for p in parts])
                    order = np.argsort(cell, kind="stable")
                    # A vector is here once a table at most; of its places one holds it.
                    ids, some, of = np.unique(np.concatenate([p.column(2).to_numpy() for p in parts]), return_index=True, return_inverse=True)
                    x = np.concatenate([_matrix(p.column(3)) for p in parts])[some]
                    keys, first = np.unique(cell[order], return_index=True)
                    index, parts = (x, ids, of[order], keys, first, np.append(first[1:], len(order))), [None]
                x, ids, of, keys, first, last = index
                got = ([], [], [])
                for q, v, cells in zip(part.column(2).to_pylist(), _matrix(part.column(3)), part.column(4), strict=True):
                    c = cells.values.to_numpy()
                    k = np.searchsorted(keys, c)
                    k = np.arange(len(keys)) if c[0] == EVERYTHING else k[(k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == c)]
                    n = last[k] - first[k]
                    if not n.sum():
                        continue
                    there = np.zeros(len(ids), bool)
                    there[of[np.repeat(first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]] = True
                    rows = np.flatnonzero(there)
                    near = x[rows] @ v
                    if len(near) > top:
                        floor = np.partition(near, len(near) - top)[len(near) - top]
                        rows = rows[near >= floor - 1e-13 * len(v) * norm * np.linalg.norm(v)]  # sums in another order
                    exact = (x[rows] * v).sum(1)
                    best = np.lexsort((ids[rows], -exact))[:top]
                    got[0].extend([q] * len(best))
                    got[1].extend(ids[rows[best]].tolist())
                    got[2].extend(exact[best].tolist())
                yield pa.record_batch([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query", "id", "score"])

    return routed.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidied(run), "query long, id long, score double")


def nearest(vectors: DataFrame, every: int = EVERY, results: int = RESULTS) -> DataFrame:
    """query_id, rank, vec_id, score: up to `results` rows for each query.

    Queries are rows whose vec_id `every` divides. Null, zero and non-finite
    vectors, null ids and vectors of another than the commonest length take no
    part. Rows repeated whole count once; a query never meets its own id. Equal
    scores go to the smaller id. An empty table gives none. Other columns are not
    read; lengths may be of any size.
    """
    spark = vectors.sparkSession
    classes = stored(classes_of(vectors, every, results))
    fitted = _fit(classes, every, results)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing, n, sample, rank = fitted
    norm, shared = hashing.norm, spark.sparkContext.broadcast(sample)
    shards = 1 + n * TABLES // SHARD

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(hashing.buckets(_matrix(b.column(0))).reshape(-1) if b.num_rows else [], pa.int64())], ["cell"])

    # At most 64 * TABLES buckets.
    counts = classes.select("v").mapInArrow(tidied(cells), "cell long").groupBy("cell").count().where(F.col("count") > n / 64)
    hot = np.array(sorted(r["cell"] for r in counts.collect()), np.int64) if shards > 1 else np.zeros(0, np.int64)
    index = _routed(classes, hashing, shards, hot, None)
    asked = _routed(classes.where("n_queries > 0"), hashing, shards, hot, lambda x: _distances(x, shared.value, norm, rank))
    found = _search(index.unionByName(asked), results + 1, norm).distinct()
    members = classes.select("id", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.join(members, "id").select("query", "vec_id", "score", F.row_number().over(order).alias("k")).where(F.col("k") <= results + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best"))
    valid = classes.where("n_queries > 0").select("id", "v")
    rows = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).distinct()
    named = rows.join(valid, "v").select("query_id", F.col("id").alias("query")).join(lists, "query")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, results)
    return named.select("query_id", F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")

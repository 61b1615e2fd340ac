"""Toxic passages by maximum-scoring segments.

Every token has a score: the log-odds of being in a toxic against another
training text, under a Dirichlet prior that holds the classes' shares, zero
unless significant, less a drift that makes ordinary text negative. One linear
scan finds all maximal-scoring segments of a text (Ruzzo and Tompa, 1999). For
local scores of this kind the largest segment of n unrelated tokens follows an
extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)) (Karlin and
Altschul, 1990); lambda is the root of sum p exp(lambda s) = 1 over tokens of
other texts, K is fitted to their exceedances. Segments that n unrelated tokens
would hold by chance are dropped; a document's evidence, the sum of the others
in these units, each less ln(K n), is turned into a probability by logistic
regression on training rows that the token counts leave out.

Tokens are hashed into 2**20 buckets, so that the model has a fixed size, and
count once a document. It is fitted on the SAMPLE training rows of each class
with the least hash of their id (all, if fewer), near copies once; class weights
restore the share of each class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import WordHash, held_out, text_bytes, tidied

BUCKETS = 1 << 20
SAMPLE = (40_000, 10_000)  # rows of other and toxic texts
PRIOR = 2.0  # pseudo-documents of the Dirichlet prior
LEAST_Z = 4.0
DRIFT = 0.4
MOST = 6.0  # of one token's score
FOLDS = 5
SIGNIFICANCE = 0.05  # segments as strong that unrelated tokens of a text's length may be expected to hold

_tokens = re.compile(rb"[a-z\x80-\xff]+").findall


class _Bucket(WordHash):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        b = self[token] = xxhash.xxh32_intdigest(token) & (BUCKETS - 1)
        return b


_bucket = _Bucket()


def buckets(text: bytes) -> np.ndarray:
    t = _tokens(text.lower())
    return np.fromiter(map(_bucket.__getitem__, t), np.int64, len(t))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [lo, hi) of a sequence with their sums."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float]] = []  # lo, hi, sum before, sum to the end
    for i in at.tolist():
        lo, hi, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            # The nearest segment that begins lower than this one.
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            lo, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((lo, hi, left, right))
    return [(lo, hi, right - left) for lo, hi, left, right in stack]


def surprise(strength: float, n: int, log_k: float) -> float:
    """Minus the logarithm of the number of segments as strong that n unrelated tokens are expected to hold."""
    return strength - max(0.0, log_k + math.log(max(n, 1)))


def evidence(strengths: list[float], n: int, log_k: float) -> float:
    """Sum of the surprises of the significant segments of n tokens."""
    found = (surprise(s, n, log_k) for s in strengths)
    return sum(x for x in found if x >= -math.log(SIGNIFICANCE))


def sketch(text: bytes) -> int:
    """The least hash of the 5-word runs; near copies mostly share it."""
    w = text.split()
    return min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) - (1 << 63)


@dataclass
class Model:
    scores: np.ndarray  # by bucket, float32
    rate: float  # lambda
    log_k: float
    weights: tuple[float, float]  # of the logistic: intercept, evidence
    base: float  # share of toxic rows, the answer where nothing was learned

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float]], float]:
        """Significant segments (token positions, strength in units of the law) in order and the evidence of the text."""
        b = buckets(text)
        found = [(lo, hi, self.rate * s) for lo, hi, s in segments(self.scores[b])]
        found = [x for x in found if surprise(x[2], len(b), self.log_k) >= -math.log(SIGNIFICANCE)]
        return found, evidence([s for _, _, s in found], len(b), self.log_k)

    def probability(self, x: float) -> float:
        if not np.isfinite(self.weights[0]):
            return self.base
        z = self.weights[0] + self.weights[1] * np.log1p(x)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with a little ridge, by Newton's method."""
    a = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    else:
        raise RuntimeError("the logistic regression does not converge")
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """A model of the training rows: label rows whose crc32(doc_id as text) mod 5 is not 0.

    A doc_id with several labels takes the highest; null ids and labels are left
    out. Null and empty texts have no tokens; repeated rows and near copies count
    once, the one with the least id. Other columns, whatever their names, are not
    read. Without training rows of both classes the model answers the share of
    toxic rows. The same rows give the same model however they are dealt out.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), FOLDS))
    sizes = {0: 0, 1: 0}
    for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("c")).count().collect():
        sizes[r["c"]] += r["count"]
    base = sizes[1] / max(1, sum(sizes.values()))
    nothing = Model(np.zeros(BUCKETS, np.float32), 1.0, 0.0, (float("nan"), 0.0), base)
    if not sizes[0] or not sizes[1]:
        return nothing
    parts = [known.where((F.col("toxic") > 0) == bool(c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[c]).select(F.col("doc_id").alias("_id"), F.lit(c).alias("_toxic")) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most sum(sample) rows of 12 bytes
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = src.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_toxic").alias("toxic"), (fold == FOLDS - 1).alias("calibrates"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, docs_in = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                got[c][np.unique(buckets(text))] += 1
                docs_in[c] += 1
        yield pa.record_batch([pa.array([-1], pa.int64()), *(pa.array([n], pa.int64()) for n in docs_in)], ["bucket", "other", "toxic"])
        at = np.flatnonzero(got.any(0))
        for i in range(0, len(at), 1 << 14):
            k = at[i : i + (1 << 14)]
            yield pa.record_batch([pa.array(k), pa.array(got[0][k].astype(np.int64)), pa.array(got[1][k].astype(np.int64))], ["bucket", "other", "toxic"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([sketch(t) for t in text_bytes(b.column(2))], pa.int64()), b.column(2)], ["doc_id", "toxic", "sketch", "text"])

    counted = rows.where(~F.col("calibrates")).select("doc_id", "toxic", "text").mapInArrow(tidied(sketched), "doc_id long, toxic int, sketch long, text string")
    counted = counted.groupBy("toxic", "sketch").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    totals = counted.select("toxic", "text").mapInArrow(tidied(count), "bucket long, other long, toxic long")
    # At most BUCKETS + 1 rows.
    t = totals.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    at, found = t["bucket"].to_numpy(), [t["other"].to_numpy(), t["toxic"].to_numpy()]
    y, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for c in (0, 1):
        y[c][at[at >= 0]] = found[c][at >= 0]
        n[c] = found[c][at < 0].sum()
    if not n.all():
        return nothing
    share = n / n.sum()
    prior = PRIOR * share[:, None]
    delta = np.log((y[1] + prior[1]) / (y[0] + prior[0])) - np.log(share[1] / share[0])
    z = delta / np.sqrt(1 / (y[1] + prior[1]) + 1 / (y[0] + prior[0]))
    scores = np.where(np.abs(z) >= LEAST_Z, np.clip(delta, -2, MOST), 0.0) - DRIFT
    scores = scores.astype(np.float32)
    # lambda over tokens of other texts.
    p = (y[0] + prior[0] * (y[1] > 0)) / (y[0] + prior[0] * (y[1] > 0)).sum()
    lo, hi = 1e-3, 1.0
    mean = lambda r: float((p * np.exp(r * scores.astype(np.float64))).sum()) - 1
    while mean(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 0 else (lo, mid)
    rate = (lo + hi) / 2
    shared = spark.sparkContext.broadcast(scores)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in text_bytes(b.column(2)):
                k = buckets(text)
                out.append(([s for _, _, s in segments(shared.value[k])], len(k)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.list_(pa.float64())), pa.array([x[1] for x in out], pa.int64())], ["doc_id", "toxic", "sums", "n"])

    # At most sum(sample) ids.
    m = rows.where("calibrates").select("doc_id", "toxic", "text").mapInArrow(tidied(measure), "doc_id long, toxic int, sums array<double>, n long").distinct().orderBy("doc_id", "n", "sums").toPandas()
    if m.toxic.nunique() < 2:
        return nothing
    other = m[m.toxic == 0]
    top = other.sums.map(lambda s: max(s, default=0.0)).to_numpy()
    level = np.quantile(top[top > 0], 0.5) if (top > 0).any() else 1.0
    log_k = float(np.log(max((top >= level).sum(), 0.5)) - np.log((other.n.to_numpy() * np.exp(-rate * level)).sum() + 1e-300))
    x = np.log1p(np.array([evidence([rate * s for s in sums], k, log_k) for sums, k in zip(m.sums, m.n, strict=True)]))
    c = m.toxic.to_numpy()
    w = np.where(c == 1, base / max((c == 1).mean(), 1e-9), (1 - base) / max((c == 0).mean(), 1e-9))
    return Model(scores, rate, log_k, _logistic(x, c, w), base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (token positions and strength), a row for each row of docs.

    Null and empty texts have no tokens and get the score of no evidence. A null
    id counts as training. Repeated rows each get their result, an empty table
    gives none. A score of exactly 0.5 predicts 1. Texts are scanned whole
    whatever their length. Other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("strength", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.passages(text) for text in text_bytes(b.column(2))]
            p = [m.probability(x) for _, x in found]
            rows = [[{"lo": lo, "hi": hi, "strength": s} for lo, hi, s in f] for f, _ in found]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(rows, kind)], ["doc_id", "held_out", "score", "predicted", "passages"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    return src.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int, passages array<struct<lo:int,hi:int,strength:double>>")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, unchanged; nulls, empty, long and repeated texts as in score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.probability(m.passages(t)[1]) < 0.5 for t in text_bytes(b.column(at))], pa.bool_()))

    # Columns by position, whatever their names.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(tidied(run), plain.schema).toDF(*docs.columns)

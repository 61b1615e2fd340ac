"""SimHash near-duplicates by a self-join of binary tries.

A trie over the distinct fingerprints is joined with itself: node pairs go
down together, each step into unequal children adds a differing bit, and a
pair is pruned once its bits exceed the budget.

For distribution the trie is kept in rotated bit orders. Two fingerprints that
differ in at most two bits agree on one of three disjoint blocks of 21 bits,
so in the rotation that puts this block first they lie below one node of depth
21. Nodes of that depth are thus independent, and each is joined with itself
in one task. A node with more than `most` fingerprints is split the same way
on its remaining 43 bits, and again on 29, after which at most 2**20
fingerprints can share a node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import components, map_batches, stored, text_bytes, tidied

BUDGET = 2
SEED = 42
NODE = 4096
FRONTIER = 1 << 18  # node pairs in hand


def shingle_hashes(text: bytes, k: int = 3) -> list[int]:
    """XXH64 of each k-word shingle of the ASCII-lower-cased text; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(line, SEED)]
    h, out, start = xxhash.xxh64_intdigest, [], 0
    end = len(b" ".join(words[:k]))
    out.append(h(line[:end], SEED))
    for first, last in zip(words, words[k:], strict=False):
        start += len(first) + 1
        end += len(last) + 1
        out.append(h(line[start:end], SEED))
    return out


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 without words. As a signed 64-bit integer."""
    hashes = shingle_hashes(text)
    n = len(hashes)
    if not n:
        return 0
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), copy (64-bit hash of the text), a row for each row of docs."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), b.column(1), pa.array(map(fingerprint, text_bytes(b.column(2))), pa.int64())], ["doc_id", "copy", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    return map_batches(src, each, "doc_id long, copy long, fp long")


def pair_blocks(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int = BUDGET, most: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of x (uint64, distinct and sorted within each node [lo, hi)) that differ in at most budget bits, in blocks.

    Node pairs of a level go down together, at most `most` at once, the others wait; a pair of leaves is settled at once.
    """
    wide = hi - lo > 1
    waiting = [(63 - depth, lo[wide], hi[wide], lo[wide], hi[wide], np.zeros(int(wide.sum()), np.int8))]
    while waiting:
        bit, al, ah, bl, bh, err = waiting.pop()
        if bit < 0 or not len(al):
            continue
        if len(al) > most:
            half = len(al) // 2
            waiting += [(bit, *(v[part] for v in (al, ah, bl, bh, err))) for part in (slice(half, None), slice(half))]
            continue
        ones = np.zeros(len(x) + 1, np.int64)
        np.cumsum((x >> np.uint64(bit)) & np.uint64(1), out=ones[1:], dtype=np.int64)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own, spare = al == bl, err < budget
        parts = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, spare), (am, ah, bl, bm, err + 1, spare & ~own)]
        kept = []
        for a, b, c, d, e, where in parts:
            na, nb = b - a, d - c
            ok = (na > 0) & (nb > 0) & ~((a == c) & (na == 1))
            if where is not None:
                ok &= where
            leaf = ok & (na == 1) & (nb == 1)
            if leaf.any():
                i, j = a[leaf], c[leaf]
                near = np.bitwise_count(x[i] ^ x[j]) <= budget
                yield i[near], j[near]
            ok &= ~leaf
            kept.append([v[ok] for v in (a, b, c, d, e)])
        waiting.append((bit - 1, *(np.concatenate(v) for v in zip(*kept, strict=True))))


def forest(n: int, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of 0 ... n - 1 under the pairs, as members and their roots."""
    root = np.arange(n)
    for i, j in blocks:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    members = np.flatnonzero(root != np.arange(n))
    return members, root[members]


def _join_nodes(nodes: DataFrame, depth: int) -> DataFrame:
    """Edges (a, b) between fingerprints of one node; nodes: (path, node, bits, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4

        def done(c: list[np.ndarray]) -> pa.RecordBatch:
            path, node, bits, fp = c
            new = np.flatnonzero((path[1:] != path[:-1]) | (node[1:] != node[:-1])) + 1
            lo, hi = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            members, roots = forest(len(fp), pair_blocks(bits.view(np.uint64), lo, hi, depth))
            return pa.record_batch([pa.array(fp[members]), pa.array(fp[roots])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            c = [np.concatenate([r, v.to_numpy(zero_copy_only=False)]) for r, v in zip(rest, b.columns, strict=True)]
            last = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [v[cut:] for v in c]
            if cut:
                yield done([v[:cut] for v in c])
        if len(rest[0]):
            yield done(rest)

    return nodes.select("path", "node", "bits", "fp").repartition("path", "node").sortWithinPartitions("path", "node", "bits").mapInArrow(tidied(run), "a long, b long")


def _rotations(bits: Column, path: Column, m: int, step: int) -> Column:
    """The three orders of the low m bits; step bits of each go on top."""
    low = (1 << m) - 1 if m < 64 else -1
    out = []
    for j in range(3):
        k = j * step
        x = bits if m == 64 else bits.bitwiseAND(F.lit(low))
        turned = x if not k else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, m - k)).bitwiseAND(F.lit(low))
        top = F.lit(0).cast("long") if m == 64 else bits.bitwiseAND(F.lit(~low))
        moved = top.bitwiseOR(turned)
        out.append(F.struct((path * 3 + j).alias("path"), F.shiftrightunsigned(moved, m - step).alias("node"), moved.alias("bits")))
    return F.array(*out)


def links(prints: DataFrame, most: int = NODE) -> DataFrame:
    """Edges (a, b) that connect every pair of distinct fingerprints (column fp) within the budget."""
    rest = prints.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("bits"), "fp")
    out, m, depth = None, 64, 0
    for step in (21, 14, 9):
        nodes = rest.select("fp", F.explode(_rotations(F.col("bits"), F.col("path"), m, step)).alias("x")).select("fp", "x.*")
        m, depth = m - step, depth + step
        sizes = stored(nodes.groupBy("path", "node").count().where("count > 1"))
        last = step == 9
        fit = sizes if last else sizes.where(F.col("count") <= most)
        edges = _join_nodes(nodes.join(fit.select("path", "node"), ["path", "node"], "left_semi"), depth)
        out = edges if out is None else out.unionByName(edges)
        hot = sizes.where(F.col("count") > most).select("path", "node")
        if last or hot.isEmpty():
            return out
        rest = nodes.join(hot, ["path", "node"], "left_semi").select("path", "bits", "fp")
    return out


def groups(prints: DataFrame, most: int = NODE) -> DataFrame:
    """fp, component_id: the least doc_id of the fingerprints that links reach; prints: (doc_id, fp, ...).

    Null ids are above all others; a component with none but these has a null component_id.
    """
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least, most)).withColumnsRenamed({"node": "fp"})
    found = stored(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, most: int = NODE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each row of docs.

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows give repeated results, equal fingerprints one component; other
    columns are not read. An empty table gives none. A text is hashed whole in
    one task, whatever its length.
    """
    prints = stored(fingerprints(docs))
    return prints.join(groups(prints, most), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = NODE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the document
    with the least doc_id stays, once if its row is repeated; null ids come last.
    Of rows with one id and several texts in a component the least hash of the
    text stays. Columns may have any names; null, empty and long texts and empty
    tables as in near_duplicates()."""
    prints = stored(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "copy")
    best = prints.groupBy("fp").agg(F.min(order).alias("best"))
    named = groups(prints, most)
    # component_id is null only where every id is; then the fingerprints' root would be lost, so take the class by fingerprint.
    keep = best.join(named, "fp").groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))).agg(F.min("best").alias("best"))
    keys = keep.select(F.col("best.doc_id").alias("_k"), F.col("best.copy").alias("_c"))
    inner = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_copy"))
    found = inner.join(keys, inner["_id"].eqNullSafe(keys["_k"]) & (inner["_copy"] == keys["_c"]), "left_semi")
    return found.dropDuplicates(["_id", "_copy"]).select("_row.*")

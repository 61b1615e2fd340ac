"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is encoded by itself. In
a piece, a segment tree over byte positions holds at each leaf the rank of the
pair that starts there, and at each inner node the least rank below it. A node
has FAN children, of which min() and index() find the least, the leftmost on a
tie, in one call each. A merge goes down from the root, joins two live
neighbours and updates three leaves at most, each in logarithmic time, so that
a piece of n bytes costs O(n log n) however long it is. Of a word's piece the
leaves are mostly the children of the root.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import forgets, map_batches

NONE = 1 << 40  # above any rank: no pair starts here
FAN = 16  # children of a node

#: The public pattern of byte_bpe_50k, and the same cut for texts that hold
#: printable ASCII, its white space and the letters U+00C0 to U+024F only. The
#: standard library's engine runs it three times as fast; other texts and
#: other patterns take the general one.
GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_TEXT = re.compile("[\t-\r -~À-ɏ]*").fullmatch
PLAIN_CUT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r {LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall


class Known(dict):
    """Ids by piece. Pieces of up to KEEP characters are remembered, the last MOST to 2 * MOST that came; others are encoded anew."""

    MOST, KEEP = 100_000, 64

    def __init__(self, piece: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self.piece, self.older = piece, {}
        forgets(self)

    def __missing__(self, s: str) -> bytes:
        ids = self.older.get(s)
        if ids is None:
            ids = array("I", self.piece(s.encode())).tobytes()
        if len(s) <= self.KEEP:
            if len(self) >= self.MOST:
                older = dict(self)
                self.clear()
                self.older = older
            self[s] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.older = {}


class Tokenizer:
    """Ranks of a tiktoken file and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.general, self.plain = regex.compile(pattern).findall, pattern == GENERAL
        self.known = Known(self.piece)

    def piece(self, b: bytes) -> list[int]:
        """Ids of one piece, by the segment tree."""
        ranks = self.ranks
        whole = ranks.get(b)
        if whole is not None:
            return [whole]
        n = len(b)
        get = ranks.get
        leaves = [get(b[i : i + 2], NONE) for i in range(n - 1)]
        leaves.append(NONE)  # nothing follows the last byte
        end = list(range(1, n + 1))  # of the live part that starts here
        start = list(range(n))  # of the live part that ends just before position + 1
        if n <= FAN:  # the root's children are the leaves
            while (least := min(leaves)) < NONE:
                i = leaves.index(least)
                j = end[i]
                e = end[i] = end[j]
                start[e - 1] = i
                leaves[j] = NONE
                leaves[i] = get(b[i : end[e]], NONE) if e < n else NONE
                if i:
                    p = start[i - 1]
                    leaves[p] = get(b[p:e], NONE)
        else:
            levels = [leaves]  # up to the root's children
            while len(x := levels[-1]) > FAN:
                levels.append([min(x[i : i + FAN]) for i in range(0, len(x), FAN)])
            root, inner, down = levels[-1], levels[1:], levels[-2::-1]

            def put(i: int, value: int) -> None:
                x = leaves
                x[i] = value
                for above in inner:
                    i //= FAN
                    value = min(x[FAN * i : FAN * i + FAN])
                    if above[i] == value:
                        break
                    above[i] = value
                    x = above

            while (least := min(root)) < NONE:
                i = root.index(least)
                for x in down:
                    i = x.index(least, FAN * i)
                j = end[i]
                e = end[i] = end[j]
                start[e - 1] = i
                put(j, NONE)
                put(i, get(b[i : end[e]], NONE) if e < n else NONE)
                if i:
                    p = start[i - 1]
                    put(p, get(b[p:e], NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[b[i : end[i]]])
            i = end[i]
        return out

    def cut(self, text: str) -> list[str]:
        return PLAIN_CUT(text) if self.plain and PLAIN_TEXT(text) else self.general(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker; the file must be where every executor has it."""
    return Tokenizer(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, ids (binary, little-endian uint32), decoded (binary).

    A null text counts as empty and gives empty ids; null ids and repeated rows
    stay as they are; other columns are not read. No shuffle.
    """

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        ids = [t.encode(x.as_py() or "") for x in b.column(1)]
        return pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(map(t.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(src, each, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same ids and bytes, hashed where they are made.

    A row for each row of docs, repeated ones too; a null text counts as empty, a
    null id stays null, an empty table gives none. Of equal ranks the leftmost
    merges first. A text is encoded whole in one task, whatever its length.
    Other columns are not read.
    """

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        n, a, d = [], [], []
        for x in b.column(1):
            ids = t.encode(x.as_py() or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            d.append(hashlib.sha256(t.decode(ids)).hexdigest())
        return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(src, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32), exact (whether decoding gives the text's bytes back);
    nulls, empty, long and repeated texts as in digests()."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        texts = [x.as_py() or "" for x in b.column(1)]
        ids = [t.encode(x) for x in texts]
        exact = [t.decode(i) == x.encode() for i, x in zip(ids, texts, strict=True)]
        return pa.record_batch([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids", "exact"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(src, each, "doc_id long, n_tokens long, ids binary, exact boolean")

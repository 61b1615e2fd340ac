"""Trigram language model in Elias-Fano tries, built and queried in shards.

A trie has three levels, first words, second words below them and third words
below these. A level is one increasing sequence kept by Elias-Fano: the words
below a context stand as distances from the last value of the context before,
so that a search is relative to its context, whose range a sequence of pointers
gives. Second and third words have 16-bit codes of their n-gram's quantised
probability. All arrays of a trie are one buffer of bytes, from which it is
opened without a copy, be it a shard's own or a memory-mapped file.

A corpus-sized trie fits no single machine, so no trie is broadcast. Documents
are read in chunks of about CHUNK tokens. A first exchange counts words and
numbers them, frequent ones first. In a second one a chunk sends each shard its
distinct pairs and triples with their counts from training documents; a shard
sums them, builds its trie, looks everything asked up in it and answers with
codes in the order asked. Pairs and triples go by their first word, so that a
trie's levels are whole. First words of over a thousandth of the tokens (a
bounded list) are spread by the second word, triples of two such words by the
third.

With the additive unigram estimate p1 of the base score, the probability of w
after v is p2 = (c(vw) + MU p1(w)) / (c(v) + MU) and after uv it is
(c(uvw) + MU p2(w | v)) / (c(uv) + MU), so that both sum to one over the
vocabulary and an unknown word. The start of a text is a context of its own,
its first word has that context only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import held_out, stored, text_bytes, tidied

MU = 8.0
ALPHA = 0.1
FOLDS = 10
CHUNK = 1_000_000  # tokens; a chunk ends with the document that reaches it
SHARD_CHARS = 8_000_000  # of the corpus for each shard
HOT = 1000  # a context over 1/HOT of the tokens is spread
CODE = 65534 / 14.0  # steps for each power of ten; code 0 is absent
START = 0  # number of the start of a text; words have higher ones


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


# Elias-Fano


_ones = np.array([bin(i).count("1") for i in range(256)], np.int64)
_zero_at = np.array([[z[k] if k < len(z) else 8 for k in range(8)] for i in range(256) for z in [[b for b in range(8) if not i >> b & 1]]], np.int64)
_one_at = _zero_at[::-1]


class EliasFano:
    """An increasing sequence of unsigned integers (repeats allowed) in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(_ones[high])])
        self.zeros = 8 * np.arange(len(high) + 1) - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros((int(high[-1]) if n else 0) + n + 2, np.uint8)
        flags[high + np.arange(n)] = 1
        low = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
        return cls(n, bits, np.concatenate([np.packbits(low.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)]), np.packbits(flags, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        # Eight bytes from any byte on; low ends with eight that are not used.
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th zero of the high part."""
        byte = np.searchsorted(self.zeros, k, "right") - 1
        return 8 * byte + _zero_at[self.high[byte], k - self.zeros[byte]]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th elements."""
        byte = np.searchsorted(self.ones, i, "right") - 1
        place = 8 * byte + _one_at[self.high[byte], i - self.ones[byte]]
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first element not below each value within its high part, and whether it equals the value."""
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        values = values.astype(np.uint64)
        h = (values >> np.uint64(self.low_bits)).astype(np.int64)
        most = int(self.zeros[-1]) - 1
        inside = h < most
        h = np.minimum(h, most - 1)
        lo = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1 - h, 0)
        hi = np.minimum(self._zero(h) - h, self.n)
        end = hi.copy()
        want = values & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        hit = inside & (lo < end)
        hit[hit] = self._low(lo[hit]) == want[hit]
        return lo, hit

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).view(np.uint8), self.low, self.high]


def _unpack(buffer: np.ndarray, at: int) -> tuple[EliasFano, int]:
    n, bits, a, b = buffer[at : at + 32].view(np.int64).tolist()
    at += 32
    return EliasFano(n, bits, buffer[at : at + a], buffer[at + a : at + a + b]), at + (a + b + 7) // 8 * 8


class Level:
    """Words below contexts, as distances from the last value of the context before."""

    def __init__(self, pointers: EliasFano, words: EliasFano) -> None:
        self.pointers, self.words = pointers, words

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, contexts: int) -> Level:
        """From pairs sorted by context, a number below contexts, and word."""
        first = np.searchsorted(context, np.arange(contexts + 1))
        last = np.zeros(contexts, np.uint64)
        full = first[1:] > first[:-1]
        last[full] = word[first[1:][full] - 1] + np.uint64(1)
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)])
        return cls(EliasFano.build(first), EliasFano.build(base[context] + word))

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word below its context, and whether it is there."""
        # Neighbouring questions mostly have one context.
        new = np.flatnonzero(np.diff(context, prepend=-1))
        some, times = context[new], np.diff(np.append(new, len(context)))
        lo, hi = self.pointers.get(some).astype(np.int64), self.pointers.get(some + 1).astype(np.int64)
        base = np.zeros(len(lo), np.uint64)
        base[lo > 0] = self.words.get(lo[lo > 0] - 1) + np.uint64(1)
        at, hit = self.words.successor(np.repeat(base, times) + word)
        return at, hit & (at >= np.repeat(lo, times)) & (at < np.repeat(hi, times))


class Trie:
    """First words, levels below them and codes."""

    def __init__(self, roots: EliasFano, levels: list[Level], codes: list[np.ndarray]) -> None:
        self.roots, self.levels, self.codes = roots, levels, codes

    @classmethod
    def build(cls, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Trie:
        """pairs: (u, v, code) sorted by u and v; triples: (number of the pair, w, code) sorted."""
        u, v, code2 = pairs
        parent, w, code3 = triples
        roots, of = np.unique(u, return_inverse=True)
        levels = [Level.build(of, v, len(roots)), Level.build(parent, w, len(u))]
        return cls(EliasFano.build(roots), levels, [code2.astype(np.uint16), code3.astype(np.uint16)])

    def pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each pair, -1 if absent, and its code, 0 if absent."""
        i, known = self.roots.successor(u)
        number, codes = np.full(len(u), -1, np.int64), np.zeros(len(u), np.uint16)
        at = np.flatnonzero(known)
        j, hit = self.levels[0].find(i[at], v[at])
        number[at[hit]] = j[hit]
        codes[at[hit]] = self.codes[0][j[hit]]
        return number, codes

    def triples(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Code of each word below a numbered pair, 0 if absent."""
        codes = np.zeros(len(pair), np.uint16)
        at = np.flatnonzero(pair >= 0)
        k, hit = self.levels[1].find(pair[at], w[at])
        codes[at[hit]] = self.codes[1][k[hit]]
        return codes

    def tobytes(self) -> bytes:
        out = bytearray()
        for sequence in (self.roots, *(x for level in self.levels for x in (level.pointers, level.words))):
            for x in sequence.parts():
                out += x.tobytes()
            out += bytes(-len(out) % 8)
        for codes in self.codes:
            out += codes.tobytes() + bytes(-2 * len(codes) % 8)
        return bytes(out)

    @classmethod
    def open(cls, buffer: bytes | np.ndarray) -> Trie:
        """A trie over a buffer, such as np.memmap(path, np.uint8, 'r')."""
        b = np.frombuffer(buffer, np.uint8) if isinstance(buffer, bytes) else buffer
        at, found, codes = 0, [], []
        for _ in range(5):
            one, at = _unpack(b, at)
            found.append(one)
        levels = [Level(found[1], found[2]), Level(found[3], found[4])]
        for level in levels:
            codes.append(b[at : at + 2 * level.words.n].view(np.uint16))
            at += (2 * level.words.n + 7) // 8 * 8
        return cls(found[0], levels, codes)


# Compact cells


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, each in as many bytes as its largest needs, byte by byte, compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head += [len(a), width]
        planes.append(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(np.array(head, "<u4").tobytes() + b"".join(planes), 1)


def _open(b: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    head = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(n, 2).tolist()
    out, at = [], 4 + 8 * n
    for size, width in head:
        a = np.zeros((size, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(a.view("<u8").reshape(-1))
        at += size * width
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of an increasing sequence, which np.cumsum() takes back."""
    return np.diff(a.astype(np.uint64), prepend=np.uint64(0))


# Chunks


@dataclass
class Chunk:
    name: int
    ids: list
    held: list[bool]
    words: np.ndarray  # distinct hashes, sorted by shard and hash
    cuts: np.ndarray  # where the words of each shard begin, and their number
    tokens: np.ndarray  # index into words, each document ending with END
    ends: np.ndarray  # of documents in tokens

    def training(self) -> np.ndarray:
        """Whether each token is of a training document."""
        return np.repeat(~np.array(self.held, bool), np.diff(self.ends, prepend=0))


class _Codes(dict):
    """0, 1, ... by first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _chunks(batches: Iterator[pa.RecordBatch], shards: int, most: int) -> Iterator[Chunk]:
    """Of (doc_id, held_out, text). Chunks of one partition are the same in every pass; answers are checked against what was asked."""
    part, count = TaskContext.get().partitionId(), 0
    end = b" end"  # no word has a space

    def made() -> Chunk:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))
        shard = _shard(hashes, shards)
        order = np.lexsort((hashes, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        return Chunk((part << 32) | count, ids, held, hashes[order], cuts, place[np.concatenate(rows)], np.cumsum([len(r) for r in rows]))

    codes, ids, held, rows, total = _Codes(), [], [], [], 0
    for b in batches:
        for i, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
            w = text.lower().split()
            w.append(end)
            rows.append(np.fromiter(map(codes.__getitem__, w), np.int32, len(w)))
            ids.append(i)
            held.append(h)
            total += len(w)
            if total >= most:
                yield made()
                count += 1
                codes, ids, held, rows, total = _Codes(), [], [], [], 0
    if ids:
        yield made()


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return ((_mix(x) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


#: shard: of words or n-grams, or below 0 for what a chunk keeps; a row with a null chunk holds a shard's sums.
CELLS = "shard long, chunk long, a binary, b binary"


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    s, k, a, b = zip(*rows, strict=True)
    return pa.record_batch([pa.array(s, pa.int64()), pa.array(k, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["shard", "chunk", "a", "b"])


def _word_cells(shards: int, most: int):
    """Each chunk's distinct words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, shards, most):
            n = np.bincount(c.tokens[c.training()], minlength=len(c.words))
            some = np.flatnonzero(np.diff(c.cuts)).tolist()
            yield _cells([(s, c.name, _pack(_steps(c.words[i:j]), n[i:j]), None) for s, i, j in zip(some, c.cuts[:-1][some].tolist(), c.cuts[1:][some].tolist(), strict=True)])

    return run


def _number_words(shards: int, least_hot: float):
    """Counts and numbers of each chunk's words, and of a shard the number of known words, their sum and the hot numbers.

    Numbers differ between shards and rise from 1 as counts fall.
    """

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        cells = [_open(x.as_py()) for x in group["a"]]
        keys = [np.cumsum(x[0], dtype=np.uint64) for x in cells]
        words, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, place, np.concatenate([x[1] for x in cells]).astype(np.int64))
        number = np.empty(len(words), np.int64)
        number[np.lexsort((words, -total))] = 1 + np.arange(len(words)) * shards + shard
        rows = [(shard, None, np.array([(total > 0).sum(), total.sum()], np.int64).tobytes(), number[total >= least_hot].tobytes())]
        at = 0
        for name, k in zip(group["chunk"].to_pylist(), keys, strict=True):
            mine = place[at : at + len(k)]
            # The hash tells whether a chunk asks again for the same words.
            rows.append((shard, name, _pack(total[mine], number[mine]), xxhash.xxh64_digest(k.tobytes())))
            at += len(k)
        return pa.Table.from_batches([_cells(rows)])

    return run


def _kept_cells(shards: int, most: int):
    """Chunks themselves: token indices, and ids, held, ends and hashes of the words that each shard was given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, shards, most):
            given = [xxhash.xxh64_digest(c.words[i:j].tobytes()) for i, j in zip(c.cuts, c.cuts[1:], strict=False)]
            info = pa.table({"id": pa.array(c.ids, pa.int64()), "held": pa.array(c.held, pa.bool_()), "end": pa.array(c.ends, pa.int64())})
            yield _cells([(-1 - c.name, c.name, _pack(c.tokens, c.cuts), _stream(info) + _stream(pa.table({"given": given})))])

    return run


def _stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as f:
        f.write_table(t)
    out = sink.getvalue().to_pybytes()
    return len(out).to_bytes(8, "little") + out


def _load(name: int, tokens: np.ndarray, cuts: np.ndarray, info: bytes) -> tuple[Chunk, list[bytes]]:
    n = 8 + int.from_bytes(info[:8], "little")
    t, given = (pa.ipc.open_stream(x).read_all() for x in (info[8:n], info[n + 8 :]))
    cuts = cuts.astype(np.int64)
    return Chunk(name, t["id"].to_pylist(), t["held"].to_pylist(), np.arange(cuts[-1]), cuts, tokens.astype(np.int64), t["end"].to_numpy()), given["given"].to_pylist()


class Layout:
    """The distinct pairs and triples of a chunk, and those that each shard gets, in the order of numbers."""

    def __init__(self, c: Chunk, hot: np.ndarray, shards: int) -> None:
        m = len(c.words)
        self.first = np.concatenate([[0], c.ends[:-1]])
        before = np.empty(len(c.tokens), np.int64)
        before[1:] = c.tokens[:-1]
        before[self.first] = m  # the start
        keys, self.pair_at = np.unique(before * m + c.tokens, return_inverse=True)
        self.u, self.v = keys // m, keys % m
        # The context of a triple is the pair that ends before its last word.
        self.inner = np.ones(len(c.tokens), bool)
        self.inner[self.first] = False
        at = np.flatnonzero(self.inner)
        keys, self.triple_at = np.unique(self.pair_at[at - 1] * m + c.tokens[at], return_inverse=True)
        self.parent, self.w = keys // m, keys % m
        warm = np.append(hot, True)
        of = np.append(np.repeat(np.arange(shards), np.diff(c.cuts)), 0)  # shard of each word
        home = np.where(warm[self.u], of[self.u] + of[self.v], of[self.u]) % shards
        spread = warm[self.u] & warm[self.v]
        there = np.where(spread[self.parent], of[self.u[self.parent]] + of[self.v[self.parent]] + of[self.w], home[self.parent]) % shards
        # Contexts go along with triples that have another shard than their pair.
        guests = np.unique(there[home[self.parent] != there] * len(self.u) + self.parent[home[self.parent] != there])
        shard = np.concatenate([home, guests // len(self.u)])
        pair = np.concatenate([np.arange(len(self.u)), guests % len(self.u)])
        own = np.arange(len(pair)) < len(self.u)
        order = np.argsort((shard * (m + 1) + self.u[pair]) * (m + 1) + self.v[pair])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry = self.parent.copy()  # where the context of a triple stands in (shard, pair)
        away = home[self.parent] != there
        entry[away] = len(self.u) + np.searchsorted(guests, there[away] * len(self.u) + self.parent[away])
        # Triples in the order of their contexts, which are in the order of shards.
        below = np.argsort(place[entry] * (m + 1) + self.w)
        self.pair, self.own, self.triple = pair[order], own[order], below
        shard, context = shard[order], place[entry][below]
        self.shards, lo = np.unique(shard, return_index=True)
        self.pair_cuts = np.append(lo, len(shard))
        self.triple_cuts = np.searchsorted(context, self.pair_cuts)
        self.children = np.bincount(context, minlength=len(shard))

    def parts(self) -> Iterator[tuple[int, slice, slice]]:
        """Shards and their stretches of pair and triple."""
        for i, s in enumerate(self.shards.tolist()):
            yield s, slice(self.pair_cuts[i], self.pair_cuts[i + 1]), slice(self.triple_cuts[i], self.triple_cuts[i + 1])


def _answered(group: pa.Table, hot: np.ndarray) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """A chunk with its words' counts and numbers (the start's is last), which of them are hot, and its ids and ends as bytes."""
    answers, kept = {}, None
    for s, a, b in zip(group["shard"].to_pylist(), group["a"], group["b"], strict=True):
        if s < 0:
            kept = (*_open(a.as_py()), b.as_py())
        else:
            answers[s] = (*_open(a.as_py()), b.as_py())
    c, given = _load(group["chunk"][0].as_py(), *kept)
    count, number = np.zeros(len(c.words), np.int64), np.zeros(len(c.words) + 1, np.int64)
    number[-1] = START
    for s, (i, j) in enumerate(zip(c.cuts, c.cuts[1:], strict=False)):
        if i < j:
            n, k, same = answers.pop(s, (None, None, None))
            if same != given[s]:
                raise RuntimeError("answers for other words than are asked for")
            count[i:j], number[i:j] = n, k
    return c, count, number, np.isin(number[:-1], hot), kept[2]


def _keep(hot: np.ndarray):
    """Of a chunk and the answers for its words: what it keeps until its n-grams are answered."""

    def run(group: pa.Table) -> pa.Table:
        c, count, _, warm, info = _answered(group, hot)
        return pa.Table.from_batches([_cells([(-1 - c.name, c.name, _pack(c.tokens, c.cuts, count, np.flatnonzero(warm)), info)])])

    return run


def _ask(shards: int, hot: np.ndarray):
    """Of a chunk and the answers for its words: what it asks shards for."""

    def run(group: pa.Table) -> pa.Table:
        c, _, number, warm, _ = _answered(group, hot)
        name, x = c.name, Layout(c, warm, shards)
        training = c.training()
        pairs = np.bincount(x.pair_at[training], minlength=len(x.u))
        triples = np.bincount(x.triple_at[training[x.inner]], minlength=len(x.w))
        rows = []
        for s, p, t in x.parts():
            mine, third = x.pair[p], x.triple[t]
            # Pairs stand in the order of their first words.
            u = x.u[mine]
            new = np.flatnonzero(np.diff(u, prepend=-1))
            many = np.diff(np.append(new, len(u)))
            rows.append((s, name, _pack(number[u[new]], many, number[x.v[mine]], np.where(x.own[p], pairs[mine], 0), x.children[p], number[x.w[third]], triples[third]), None))
        return pa.Table.from_batches([_cells(rows)])

    return run


def quantised(counts: np.ndarray, n: int) -> np.ndarray:
    """16-bit codes of probabilities counts / n; 0 for none."""
    codes = np.clip(np.round(65535 + CODE * np.log10(np.maximum(counts, 1) / max(n, 1))), 1, 65535)
    return np.where(counts > 0, codes, 0)


def frequency(codes: np.ndarray, n: int) -> np.ndarray:
    """The counts that codes stand for."""
    return np.where(codes > 0, n * 10.0 ** ((codes.astype(np.float64) - 65535) / CODE), 0.0)


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, and the place of each there."""
    wide = int(word.max(initial=0)) + 1
    if int(context.max(initial=0) + 1) * wide < 1 << 63:
        keys, place = np.unique(context * wide + word.astype(np.int64), return_inverse=True)
        return keys // wide, (keys % wide).astype(np.uint64), place
    words, rank = np.unique(word, return_inverse=True)
    keys, place = np.unique(context * len(words) + rank, return_inverse=True)
    return keys // len(words), words[keys % len(words)], place


def _answer(n_train: int):
    """Codes of what each chunk asks for, from the trie of this shard."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        cells = [_open(x.as_py()) for x in group["a"]]
        us, iu = np.unique(np.concatenate([x[0] for x in cells]), return_inverse=True)
        iu = np.repeat(iu, np.concatenate([x[1] for x in cells]).astype(np.int64))
        v = np.concatenate([x[2] for x in cells])
        first = np.cumsum([0, *(len(x[2]) for x in cells)])
        parent = np.concatenate([at + np.repeat(np.arange(len(x[4])), x[4].astype(np.int64)) for at, x in zip(first, cells, strict=False)])
        w = np.concatenate([x[5] for x in cells])
        # Equal pairs and triples of all chunks, in order.
        pu, pv, pair = _distinct(iu, v)
        tp, tw, triple = _distinct(pair[parent], w)
        pu = us[pu]
        n2 = np.bincount(pair, np.concatenate([x[3] for x in cells]).astype(np.float64), len(pu))
        n3 = np.bincount(triple, np.concatenate([x[6] for x in cells]).astype(np.float64), len(tp))
        trie = Trie.open(build(pu, pv, n2, tp, tw, n3, n_train).tobytes())
        number, code2 = trie.pairs(pu, pv)
        code3 = trie.triples(number[tp], tw)
        rows, last = [], np.cumsum([0, *(len(x[5]) for x in cells)])
        for k, name in enumerate(group["chunk"].to_pylist()):
            rows.append((shard, name, _pack(code2[pair[first[k] : first[k + 1]]], code3[triple[last[k] : last[k + 1]]]), None))
        return pa.Table.from_batches([_cells(rows)])

    return run


def build(u: np.ndarray, v: np.ndarray, n2: np.ndarray, parent: np.ndarray, w: np.ndarray, n3: np.ndarray, n: int) -> Trie:
    """Trie of the pairs (distinct and sorted) and triples (parent is the number of a pair) that were counted.

    A pair without a count stays if triples below it have one.
    """
    there = n3 > 0
    keep = n2 > 0
    keep[parent[there]] = True
    new = np.cumsum(keep) - 1
    return Trie.build((u[keep], v[keep], quantised(n2[keep], n)), (new[parent[there]], w[there], quantised(n3[there], n)))


def _score_chunk(shards: int, starts: int, n_train: int, v_train: int):
    def run(group: pa.Table) -> pa.Table:
        kept, codes = None, {}
        for s, a, b in zip(group["shard"].to_pylist(), group["a"], group["b"], strict=True):
            if s < 0:
                kept = (*_open(a.as_py()), b.as_py())
            else:
                codes[s] = _open(a.as_py())
        tokens, cuts, count, hot, info = kept
        chunk, _ = _load(group["chunk"][0].as_py(), tokens, cuts, info)
        warm = np.zeros(len(count), bool)
        warm[hot.astype(np.int64)] = True
        x = Layout(chunk, warm, shards)
        two, three = np.zeros(len(x.u)), np.zeros(len(x.w))
        for s, p, t in x.parts():
            code2, code3 = codes.pop(s)
            own = x.own[p]
            two[x.pair[p][own]] = frequency(code2[own], n_train)
            three[x.triple[t]] = frequency(code3, n_train)
        if codes:
            raise RuntimeError("answers for other n-grams than were asked for")
        c = np.append(count.astype(np.float64), starts)
        p1 = (c[:-1] + ALPHA) / (n_train + ALPHA * (v_train + 1))
        p2 = (two + MU * p1[x.v]) / (c[x.u] + MU)
        p = p2[x.pair_at]
        at = np.flatnonzero(x.inner)
        p[at] = (three[x.triple_at] + MU * p[at]) / (two[x.pair_at[at - 1]] + MU)
        total = lambda y: np.add.reduceat(y, x.first)
        known = total((c[:-1] > 0)[chunk.tokens].astype(np.int64))
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "held_out": pa.array(chunk.held, pa.bool_()), "n_tokens": pa.array(np.diff(chunk.ends, prepend=0), pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([n_train] * len(x.first), pa.int64()), "base_score": pa.array(total(np.log10(p1)[chunk.tokens])), "score": pa.array(total(np.log10(p))),
        })

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: SCHEMA.

    Null and empty texts have the end token only. A null id counts as training.
    Repeated rows count and are scored each time. An empty table gives none; with
    no training documents every count is 0. A text is one chunk at least, so a
    very long one makes a longer chunk. Other columns are not read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    size = src.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(~F.col("held_out")).alias("starts")).first()
    shards = 1 + int(size.chars // SHARD_CHARS)
    # The hot list holds at most (chars / 2 + documents) / least_hot words.
    least_hot = max(2.0, size.chars / 8 / HOT)
    words = stored(src.mapInArrow(tidied(_word_cells(shards, chunk)), CELLS).groupBy("shard").applyInArrow(_number_words(shards, least_hot), CELLS))
    known = n = 0
    warm = []
    for r in words.where("chunk is null").select("a", "b").toLocalIterator():
        x = np.frombuffer(r.a, np.int64)
        known, n = known + int(x[0]), n + int(x[1])
        warm.append(np.frombuffer(r.b, np.int64))
    hot = np.unique(np.concatenate(warm)) if warm else np.zeros(0, np.int64)
    # The texts come first, so that their partitions have the same numbers as before.
    kept = src.mapInArrow(tidied(_kept_cells(shards, chunk)), CELLS).unionByName(words.where("chunk is not null"))
    # Both read one exchange by chunk.
    answers = kept.groupBy("chunk").applyInArrow(_ask(shards, hot), CELLS).groupBy("shard").applyInArrow(_answer(n), CELLS)
    waiting = kept.groupBy("chunk").applyInArrow(_keep(hot), CELLS)
    return answers.unionByName(waiting).groupBy("chunk").applyInArrow(_score_chunk(shards, size.starts, n, known), SCHEMA)

"""Substring dedup with suffix automata of reference shards.

A window is `length` consecutive words. A word goes if a window over it also
starts in a document with a smaller id, judged on the input.

1. Winnowing picks from each window the least hash of its 8-word grams; equal
   windows pick equal grams. Neighbouring windows that pick equal grams form a
   stretch, cut after length - 7 windows, since a gram that recurs can stay the
   least of any number. Grams of one document only are done.
2. Equal stretches (gram and stretch hash) are one variant, whose reference
   text is taken from the smallest id that holds it. Its other holders ask for
   that text. Where a gram has several variants, mostly at the ends of passages,
   the owner of a variant may still share windows with a variant of a smaller
   id; window hashes lead it to the variants with the smallest ids.
3. The texts that a document asks for are its reference shards. Neighbouring
   ones are joined into passages of at most PASSAGE words; the suffix automaton
   of each streams the document's words there for matching statistics, and
   maximal spans of `length` words or more go.

Hashes only route texts to documents; words decide what is removed. A document
gets at most a reference of each of its own stretches and the variants that
share its windows. Against every shard each document would meet as many automata
as the corpus has shards.

Texts are not shuffled as a whole: a bitmap of FILTER_BITS, broadcast, tells
apart documents that certainly take no part. Past about FILTER_BITS / 4
documents it lets ever more of the others through, which then cost a shuffle of
their text and no other result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from satchel.llm.common import WordHash, discard, stored, text_bytes, tidied

LENGTH = 50
GRAM = 8
FILTER_BITS = 1 << 27  # 16 MiB, whatever the input
PASSAGE = 2000  # words of a reference passage, but for the end of the last stretch

_word_hash = WordHash()
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 1024)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: list[bytes], *sizes: int) -> list[np.ndarray]:
    """For each size a 64-bit hash of every run of so many words."""
    n = len(words)
    up, down = _power_tables(n + 1)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    return [_mix((total[k:] - total[:-k]) * down[: n + 1 - k]) if n >= k else np.zeros(0, np.uint64) for k in sizes]


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values, by doubling."""
    have, low = 1, grams
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    shift = width - have
    return np.minimum(low[: len(low) - shift], low[shift:]) if shift else low


def _window_grams(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window, and the gram that it picks."""
    k = min(GRAM, length)
    grams, windows = run_hashes(words, k, length)
    return windows, winnow(grams, length - k + 1) if len(windows) else grams[:0]


class SuffixAutomaton:
    """Of a sequence of words; next[state] maps a word to a state."""

    def __init__(self, words: list[bytes]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        nexts, link, length = self.next, self.link, self.len
        for w in words:
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and nexts[p].get(w) == q:
                        nexts[p][w] = copy
                        p = link[p]
            last = new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal [start, end) of words covered by matches of least words or more."""
        nexts, link, length = self.next, self.link, self.len
        state = size = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while (to := nexts[state].get(w)) is None:
                if not state:
                    break
                state = link[state]
                size = length[state]
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= least:
                if out and out[-1][1] >= i + 1 - size:
                    out[-1] = (min(out[-1][0], i + 1 - size), i + 1)
                else:
                    out.append((i + 1 - size, i + 1))
        return out


def _stretches(picked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of neighbouring equal values, at most so many in one."""
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    since = np.arange(len(picked)) - np.repeat(first, np.diff(np.append(first, len(picked))))
    start = np.flatnonzero(since % most == 0)
    return start, np.diff(np.append(start, len(picked)))


def _stretch_hash(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) + last * np.uint64(3) + n.astype(np.uint64))


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, gram, seg, start, n): stretches of n windows from word start on that pick equal grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                words = text.split()
                if len(words) < length:
                    continue
                windows, picked = _window_grams(words, length)
                start, n = _stretches(picked, length - min(GRAM, length) + 1)
                # The first and last window touch or overlap, so that they and their distance fix every word.
                seg = _stretch_hash(windows[start], windows[start + n - 1], n)
                ids.append(np.full(len(start), i, np.int64))
                out.append((picked[start].view(np.int64), seg.view(np.int64), start.astype(np.int32), n.astype(np.int32)))
            if ids:
                cols = [np.concatenate(ids), *(np.concatenate(c) for c in zip(*out, strict=True))]
                yield pa.record_batch([pa.array(c) for c in cols], ["doc_id", "gram", "seg", "start", "n"])

    return docs.mapInArrow(tidied(run), "doc_id long, gram long, seg long, start int, n int")


def _texts(docs: DataFrame, length: int) -> DataFrame:
    """(vid, a, several, text) of the variants that documents own; docs: (doc_id, text, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, own in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words, done = text.split(), set()
                for x in own:
                    part = words[x["start"] : x["start"] + x["n"] - 1 + length]
                    if x["vid"] in done or len(part) < x["n"] - 1 + length:
                        continue
                    (windows,) = run_hashes(part, length)
                    # Of rows with one id and several texts only some hold the stretch.
                    if int(_stretch_hash(windows[:1], windows[-1:], np.array([x["n"]])).view(np.int64)[0]) == x["seg"]:
                        done.add(x["vid"])
                        out.append((x["vid"], i, x["several"], b" ".join(part)))
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.binary())], ["vid", "a", "several", "text"])

    return docs.mapInArrow(tidied(run), "vid long, a long, several boolean, text binary")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(window, vid, a): the distinct window hashes of each variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [np.unique(run_hashes(t.split(), length)[0]).view(np.int64) for t in text_bytes(b.column(2))]
            n = [len(h) for h in hashes]
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(flat), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(b.column(1).to_numpy(), n))], ["window", "vid", "a"])

    return texts.select("vid", "a", "text").mapInArrow(tidied(run), "window long, vid long, a long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """The bits of FILTER_BITS that hashes of doc_id set, at most FILTER_BITS / 64 rows."""
    h = ids.select(F.xxhash64("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("h"))
    words = h.select(F.shiftright("h", 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, FILTER_BITS // 64), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _split_off(rows: DataFrame, ids: DataFrame) -> Callable[..., DataFrame]:
    """those(True) are rows (column _id) that may be among ids, those(False) rows that certainly are
    not; with a function of batches and its schema, what it makes of them in the same Python worker."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(ids))
    hashed = rows.withColumn("_bit", F.xxhash64("_id").bitwiseAND(F.lit(FILTER_BITS - 1)))

    def those(there: bool, then: Callable | None = None, schema: StructType | str = rows.schema) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for b in batches:
                h = b.column(b.num_columns - 1).to_numpy()
                # Numbers of 64 bits are little-endian, so byte h >> 3 holds bit h.
                yield b.drop_columns(["_bit"]).filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == there))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return then(found(batches)) if then else found(batches)

        return hashed.mapInArrow(tidied(run), schema)

    return those


def _passages(refs: list[dict], length: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(lo, hi, words) of reference passages and the document's words to stream through them.

    Texts of neighbouring stretches, which overlap by length - 1 words, are joined, so that
    every window of a passage is one of a reference.
    """
    lo = hi = 0
    words: list[bytes] = []
    for x in sorted(refs, key=lambda x: (x["start"], x["n"], x["text"])):
        more = x["text"].split()
        if words and x["start"] == hi - length + 1 and len(words) + len(more) <= PASSAGE and words[1 - length :] == more[: length - 1]:
            words += more[length - 1 :]
        else:
            if words:
                yield lo, hi, words
            lo, words = x["start"], more
        hi = x["start"] + x["n"] - 1 + length
    if words:
        yield lo, hi, words


class _Automata(dict):
    """By passage, for as long as MOST words are held."""

    MOST = 20_000

    def of(self, words: list[bytes]) -> SuffixAutomaton:
        key = b" ".join(words)
        if key not in self:
            self.held = getattr(self, "held", 0) + len(words)
            if self.held > self.MOST:
                self.clear()
                self.held = len(words)
            self[key] = SuffixAutomaton(words)
        return self[key]


def _removed(words: list[bytes], refs: list[dict], length: int, automata: _Automata) -> list[tuple[int, int]]:
    """Spans of words to remove, in order and apart."""
    found: list[tuple[int, int]] = []
    for lo, hi, passage in _passages(refs, length):
        found += [(lo + i, lo + j) for i, j in automata.of(passage).spans(words[lo:hi], length)]
    out: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out


def references(src: DataFrame, length: int) -> DataFrame:
    """(doc_id, refs): for documents that can lose words, places (start, n) and texts of their reference shards; src: (_id, text)."""
    docs = src.select(F.col("_id").alias("doc_id"), "text").where("doc_id is not null")
    every = stored(_segments(docs, length))
    shared = every.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram")
    held = stored(every.join(shared, "gram", "left_semi").distinct())
    discard(every)
    variants = stored(held.groupBy("gram", "seg").agg(F.min("doc_id").alias("a")))
    several = variants.groupBy("gram").count().where("count > 1").select("gram", F.lit(True).alias("several"))
    both = stored(held.join(variants, ["gram", "seg"]).select("doc_id", "gram", "seg", "a", "start", "n", F.xxhash64("gram", "seg").alias("vid")))
    owners = stored(both.where("doc_id = a").join(several, "gram", "left").select("doc_id", "vid", "seg", "start", "n", F.coalesce("several", F.lit(False)).alias("several")))
    discard(held, variants)
    # A document has at most as many stretches as windows.
    own = owners.groupBy("doc_id").agg(F.collect_list(F.struct("vid", "seg", "start", "n", "several")).alias("own"))
    some = _split_off(src.select("_id", "text"), owners.select("doc_id").distinct())(True)
    # Merged, not broadcast: the exchange keeps the Python workers before and after it out of one task.
    texts = stored(_texts(some.join(own.hint("merge"), F.col("_id") == F.col("doc_id")).select("doc_id", "text", "own"), length).dropDuplicates(["vid", "a"]))
    windows = _windows(texts.where("several").select("vid", "a", "text"), length)
    least = windows.groupBy("window").agg(F.min_by(F.struct("vid", "a"), F.struct("a", "vid")).alias("to"), F.min("a").alias("least"), F.max("a").alias("most")).where("least < most").select("window", "to")
    needs = windows.join(least, "window").where("a > to.a").select("vid", F.col("a").alias("doc_id"), "to").distinct()
    routed = needs.join(owners.select("doc_id", "vid", "start", "n"), ["doc_id", "vid"]).select("doc_id", "start", "n", F.col("to.vid").alias("vid"), F.col("to.a").alias("a"))
    asked = both.where("doc_id > a").select("doc_id", "start", "n", "vid", "a").unionByName(routed)
    sent = asked.join(texts.select("vid", "a", "text"), ["vid", "a"]).select("doc_id", F.struct("start", "n", "text").alias("ref"))
    refs = stored(sent.groupBy("doc_id").agg(F.collect_list("ref").alias("refs")))
    discard(both, owners, texts)
    return refs


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    kept, at = [], 0
    for i, j in spans:
        kept += words[at:i]
        at = j
    kept += words[at:]
    return kept, len(words) - len(kept)


def _with_references(rows: DataFrame, length: int, run: Callable, schema: StructType | str) -> DataFrame:
    """What run makes of batches of rows (columns _id and text among them) with a last column refs, null
    where a document loses no words. No task holds two Python workers."""
    refs = references(rows, length)
    those = _split_off(rows, refs.select("doc_id"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.append_column("refs", pa.nulls(b.num_rows)) for b in batches)

    some = those(True)
    joined = some.join(refs.hint("merge"), some["_id"] == refs["doc_id"], "left").drop("doc_id")
    return joined.mapInArrow(tidied(run), schema).union(those(False, without, schema))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row for each row of docs.

    Null and empty texts have no words. A row without an id neither loses words
    nor lets others lose any. Rows with one id are one document for the order;
    each repeated row gets its result. Of equal windows the least id keeps its
    words. Other columns are not read. An empty table gives none. A text is
    whole in one task whatever its length; automata hold PASSAGE words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata()
        for b in batches:
            n, gone, sha = [], [], []
            for text, refs in zip(text_bytes(b.column(1)), b.column(2), strict=True):
                words = text.split()
                n.append(len(words))
                words, removed = _kept(words, _removed(words, refs.as_py(), length, automata) if refs.is_valid else [])
                gone.append(removed)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    return _with_references(rows, length, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated words taken out of text; a text that loses none is
    unchanged, others have their kept words joined by one space. Every row and
    column stays; nulls, empty texts and tables, repeated rows and long texts as in dedup()."""

    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata()
        for b in batches:
            texts = []
            *cols, _, every = b.columns
            for text, raw, refs in zip(cols[at], text_bytes(cols[at]), every, strict=True):
                words, removed = [], 0
                if refs.is_valid:
                    words = raw.split()
                    words, removed = _kept(words, _removed(words, refs.as_py(), length, automata))
                texts.append(b" ".join(words).decode() if removed else text.as_py())
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    # Columns by position, whatever their names.
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain).select(*(F.col(c).alias("text") if i == at else c for i, c in enumerate(plain)), F.col(f"c{names.index('doc_id')}").cast("long").alias("_id"))
    return _with_references(rows, length, run, docs.schema)


#: DuckDB SQL for dedup() of documents.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE doc_id IS NOT NULL),
v AS (SELECT r, doc_id, i, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS words FROM x),
m AS (SELECT words, min(doc_id) AS least FROM v GROUP BY words),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {LENGTH})) AS i FROM v JOIN m USING (words) WHERE v.doc_id > m.least),
lost AS (SELECT r, count(*) AS n, list(i) AS at FROM gone GROUP BY r),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE r IN (SELECT r FROM lost)),
k AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN gone ON p.r = gone.r AND p.i = gone.i GROUP BY p.r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN lost.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN lost ON d.r = lost.r LEFT JOIN k ON d.r = k.r
"""

"""Line-first cleaning with document rules.

Each line is judged by itself (punctuation, navigation, boilerplate); failed
lines are removed, and a document that loses too many of its words is
rejected. Counts of the whole text decide the base rules.
"""

from __future__ import annotations

import re
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import SPACES, map_batches

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?…:;\"'”’)»"
SEPARATORS = "|>»•·"
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "subscribe to our newsletter", "sign up for", "log in to", "enable javascript",
    "share this", "lorem ipsum", "page not found", "skip to content", "back to top",
)
MOST_LOST = 50  # a document that loses over this percentage of its words is rejected

_boilerplate = re.compile("|".join(BOILERPLATE)).search
_end = re.compile(rf"[{re.escape(TERMINAL)}]\Z").search


def line_fails(line: str) -> bool:
    """line has a word. Three rules:

    punctuation: symbols number over a fifth of the words, or the line has
    under three words and no terminal mark at its end; navigation: separators number three or more and over a
    quarter of the words; boilerplate: a phrase of the list, in any ASCII case.
    """
    n = len(line.encode().split())
    if sum(map(line.count, SEPARATORS)) >= max(3, n // 4 + 1):
        return True
    if 5 * sum(map(line.count, SYMBOLS)) > n or n < 3 and not _end(line.rstrip(SPACES)):
        return True
    return bool(_boilerplate(line.translate(_lower)))


_lower = {i: i + 32 for i in range(65, 91)}


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words inside windows of k words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(windows) == len(set(windows)):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered[i : i + k] = b"\1" * k
    return sum(covered)


def measure(text: str | None) -> dict:
    """Counts, cleaned text and verdict of one text; null counts as empty."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = lost = removed = 0
    keep = []
    for line in lines:
        bare = bool(line.strip(SPACES))
        fails = False
        if bare:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            fails = line_fails(line)
            if fails:
                removed += 1
                lost += len(line.encode().split())
        keep.append(not fails)
    repeat = repeat_words(words)
    base_failed = n < 10 or 100 * repeat > 20 * n
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base_failed, "kept": not base_failed and 100 * lost <= MOST_LOST * n,
        "n_lines_removed": removed, "n_words_removed": lost, "cleaned": "\n".join(compress(lines, keep)),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row for each document: its counts, verdict and (with_text) cleaned text.

    A null or empty text has no words and fails the base rules. Null ids and
    repeated rows are judged row by row; the first of equal lines is no repeat.
    An empty table gives none. A text is judged whole in one task, whatever its
    length. Other columns are not read. No shuffle.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:] + ["cleaned"] * with_text
    schema = SCHEMA + ", cleaned string" * with_text

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(x.as_py()) for x in b.column(1)]
        kind = {"base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned": pa.string()}
        return pa.record_batch([b.column(0), *(pa.array([r[c] for r in rows], kind.get(c, pa.int64())) for c in names)], ["doc_id", *names])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, schema)




ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, len(ws) AS n, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w),
keyed AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS k FROM win),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n_rep FROM rep, range(5) AS x(j) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
lw AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         len(l) - len(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS sym,
         len(l) - len(regexp_replace(l, '[|>»•·]', '', 'g')) AS sep FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lf AS (SELECT r, n, row_number() OVER (PARTITION BY r, l ORDER BY p) > 1 AS dup,
         sep >= greatest(3, n // 4 + 1)
         OR 5 * sym > n
         OR (n < 3 AND NOT regexp_matches(l, '[.!?…:;"''”’)»][\x20\x09-\x0D]*$'))
         OR regexp_matches(l, '(?i){"|".join(BOILERPLATE)}') AS fails FROM lw),
la AS (SELECT r, count(*) FILTER (dup) AS n_dup, count(*) FILTER (fails) AS n_rm, coalesce(sum(n) FILTER (fails), 0) AS lost FROM lf GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(len(t) - len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS n_space,
         CAST(len(t) AS BIGINT) AS n_all,
         CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_rm, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(lost, 0) AS BIGINT) AS n_words_removed
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN la USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, n_all - n_space AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_words_removed <= {MOST_LOST} * n_words AS kept, n_lines_removed, n_words_removed
FROM b
"""

"""License scans by Dice coefficient over word bigrams.

A text is normalised (ASCII lower case, runs of other than letters, digits and
points to one space, line breaks and comment signs too) and its runs of words
are compared to licence templates: twice the shared distinct bigrams over the
sum of both counts. A run begins and ends with a bigram of the template, and
bounds on its size prune it: the coefficient can reach a threshold t only if
neither side has more than (2 - t) / t times the bigrams of the other. Notices
are thus found as lines, wrapped, in comments and inside longer paragraphs.

Most texts hold no notice. A run that reaches t shares at least t / (2 - t) of
a template's bigrams, so it holds one of any set of words that touch more than
the rest of them; texts without such words are not normalised at all. Built-in
functions only; nothing but shared bigrams is shuffled.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Public licence notices, as short forms and as headers.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
THRESHOLD = 0.8


#: Words that prove little; others are looked for first. Only speed depends on this list.
COMMON = frozenset("a above all and any appear are as at by commercial conditions copies copy either following for free from general in including is it may must no not notice of on or program provided public published purpose released subject that the this to under use used version with without work you your".split())


def normal_words(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.sub(r"[^a-z0-9.\x80-\U0010FFFF]+", " ", lower).replace(". ", " ").strip(" .").split(" ") if w]


def bigrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}


def _templates(threshold: float) -> list[tuple[str, int, int, int, int, list[str]]]:
    """License, number, distinct bigrams, how many of them a run must share, most places of a run, and the bigrams."""
    out = []
    for name, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = normal_words(text)
            b = bigrams(words)
            out.append((name, k, len(b), math.ceil(len(b) * threshold / (2 - threshold) - 1e-9), math.floor((len(words) - 1) * (2 - threshold) / threshold + 1e-9), sorted(b)))
    return out


def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Words of which every run that reaches the threshold holds one, as parts of words where one is part of another."""
    # Of each template, the bigrams not yet touched and how many more must be.
    open_ = [[{tuple(b.split(" ")) for b in found}, m - need + 1] for _, _, m, need, _, found in _templates(threshold)]
    words = sorted({w for left, _ in open_ for pair in left for w in pair}, key=lambda w: (w in COMMON, -len(w), w))
    chosen: list[str] = []
    while any(lack > 0 for _, lack in open_):
        gains = {w: sum(min(lack, sum(any(w in x for x in pair) for pair in left)) for left, lack in open_ if lack > 0) for w in words}
        rare = [w for w in words if gains[w] and w not in COMMON and len(w) > (4 if w.isalpha() else 2)]
        best = max(rare or words, key=gains.__getitem__)  # the first of equals
        chosen.append(best)
        for entry in open_:
            touched = {pair for pair in entry[0] if any(best in x for x in pair)}
            entry[0] -= touched
            entry[1] -= len(touched)
    return sorted(chosen)


def _words(c):
    lower = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(lower, r"[^a-z0-9.\x{80}-\x{10FFFF}]+", " ")
    return F.split(F.regexp_replace(F.regexp_replace(spaced, r"\. ", " "), r"^[ .]+|[ .]+$", ""), " +")


def _hits(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, row, license, k, m, need, most, at, prev): places of template bigrams, and the place before of the same bigram."""
    table = _templates(threshold)
    known = docs.sparkSession.createDataFrame([(*t[:-1], b) for t in table for b in t[-1]], "license string, k int, m int, need int, most int, bigram string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    # exists(array(x)) computes x once for all tests.
    src = src.where(F.exists(F.array(F.lower("text")), lambda x: functools.reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in anchors(threshold)))))
    # explode(array(x)) computes x once; a plain alias would be inlined wherever it is used.
    words = src.select("doc_id", "row", F.explode(F.array(_words(F.col("text")))).alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)).alias("bigram")))
    ours = F.filter(pairs, lambda x: x["bigram"].isin(sorted({b for t in table for b in t[-1]})))
    hits = words.select("doc_id", "row", F.explode(ours).alias("h")).select("doc_id", "row", "h.at", "h.bigram").join(F.broadcast(known), "bigram")
    before = Window.partitionBy("row", "license", "k", "bigram").orderBy("at")
    return hits.withColumn("prev", F.coalesce(F.lag("at").over(before), F.lit(0)))


def _best_runs(hits: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, row, license, k, lo, hi, minus): of each place where a run can begin, the end with the highest coefficient."""
    of = hits.groupBy("doc_id", "row", "license", "k", "m", "need", "most").agg(F.array_sort(F.collect_list(F.struct("at", "prev"))).alias("h"), F.count_if(F.col("prev") == 0).alias("distinct"))
    reach = lambda i: F.filter(F.slice("h", i, F.col("most")), lambda x: x["at"] < F.get("h", i - 1)["at"] + F.col("most"))
    enough = lambda h: F.size(F.filter(h, lambda x: x["prev"] < F.get(h, F.lit(0))["at"])) >= F.col("need")
    starts = F.filter(F.transform(F.sequence(F.lit(1), F.size("h")), reach), enough)
    runs = of.where(F.col("distinct") >= F.col("need")).select("doc_id", "row", "license", "k", "m", F.explode(starts).alias("h"))
    runs = runs.withColumn("lo", F.get("h", F.lit(0))["at"])

    def longer(state, x):
        same = state["same"] + (x["prev"] < F.col("lo")).cast("int")
        # Bigrams of no template count each time, others once.
        minus = -2.0 * same / (F.col("m") + x["at"] - F.col("lo") - state["n"] + same)
        better = minus < state["minus"]
        return F.struct(same.alias("same"), (state["n"] + 1).alias("n"), F.when(better, minus).otherwise(state["minus"]).alias("minus"), F.when(better, x["at"]).otherwise(state["hi"]).alias("hi"))

    none = F.struct(F.lit(0).alias("same"), F.lit(0).alias("n"), F.lit(0.0).alias("minus"), F.lit(0).alias("hi"))
    best = runs.select("doc_id", "row", "license", "k", "lo", F.aggregate("h", none, longer).alias("b"))
    return best.select("doc_id", "row", "license", "k", "lo", "b.hi", "b.minus").where(F.col("minus") <= -threshold)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (the best), n_notices (runs of words that match it), a row for each document and license found.

    Of runs that overlap the one with the highest coefficient counts, on a tie
    the longer one, then the first by license, number of the template and place.
    Null and empty texts match nothing. Rows with a null id are one document;
    repeated rows add their notices. Other columns are not read. An empty table
    gives none. Texts are whole whatever their length; the words of one text are
    an array in one task.
    """
    runs = _best_runs(_hits(docs, threshold), threshold)
    in_order = Window.partitionBy("row").orderBy("lo", "hi", "license", "k")
    # Bigrams that share a word overlap too. Runs that overlap by way of others are one island.
    apart = F.coalesce(F.col("lo") > F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    islands = runs.withColumn("island", F.sum(apart.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct("minus", (F.col("lo") - F.col("hi")).alias("size"), "license", "k", "lo", "hi")
    ranked = islands.groupBy("doc_id", "row", "island").agg(F.array_sort(F.collect_list(rank)).alias("b"))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["lo"] <= y["hi"] + 1) & (y["lo"] <= x["hi"] + 1))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    found = ranked.select("doc_id", F.explode(kept).alias("b"))
    return found.groupBy("doc_id", F.col("b.license").alias("license")).agg(F.max(-F.col("b.minus")).alias("dice"), F.count("*").alias("n_notices"))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan() of documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(n)}, {k}, {m}, {most}, [{', '.join(map(q, b))}])" for n, k, m, _, most, b in _templates(threshold))
    return rf"""
WITH t(license, k, m, most, b) AS (VALUES {rows}),
tb AS (SELECT license, k, m, most, unnest(b) AS bigram FROM t),
n AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), '\. ', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ' +') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, unnest(list_transform(range(1, len(w)), lambda i: {{'at': i, 'bigram': w[i] || ' ' || w[i + 1]}})) AS x FROM n),
h AS (SELECT r, doc_id, license, k, m, most, x.at AS pos, coalesce(lag(x.at) OVER (PARTITION BY r, license, k, bigram ORDER BY x.at), 0) AS prev FROM p JOIN tb ON x.bigram = tb.bigram),
e AS (SELECT a.r, a.doc_id, a.license, a.k, a.m, a.pos AS lo, z.pos AS hi, sum(CASE WHEN z.prev < a.pos THEN 1 ELSE 0 END) OVER o AS same, row_number() OVER o AS n
  FROM h a JOIN h z ON a.r = z.r AND a.license = z.license AND a.k = z.k AND z.pos >= a.pos AND z.pos < a.pos + a.most
  WINDOW o AS (PARTITION BY a.r, a.license, a.k, a.pos ORDER BY z.pos)),
d AS (SELECT *, -2.0 * CAST(same AS DOUBLE) / (m + hi - lo + 1 - n + same) AS minus FROM e),
s AS (SELECT r, doc_id, license, k, lo, hi, minus FROM d WHERE minus <= -{threshold} QUALIFY row_number() OVER (PARTITION BY r, license, k, lo ORDER BY minus, hi) = 1),
l AS (SELECT r, doc_id, list([{{'license': license, 'minus': minus, 'lo': lo, 'hi': hi}}] ORDER BY minus, lo - hi, license, k, lo) AS b FROM s GROUP BY r, doc_id),
f AS (SELECT doc_id, unnest(list_reduce(b, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: x[1].lo <= y.hi + 1 AND y.lo <= x[1].hi + 1)) = 0 THEN list_concat(kept, x) ELSE kept END)) AS y FROM l)
SELECT doc_id, y.license AS license, CAST(max(-y.minus) AS DOUBLE) AS dice, count(*) AS n_notices FROM f GROUP BY ALL
"""

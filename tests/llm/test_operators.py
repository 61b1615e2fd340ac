"""Operators against plain versions on small and awkward tables."""

import base64
import collections
import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from satchel.llm import ann, bpe, chat, licenses, lm, mixing, quality, simhash, substring, toxicity
from satchel.llm.common import components, tidied

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in ("al", "be", "ço", "di", "eu", "Fo") for b in ("na", "re", "si", "tö", "lu")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    passage, base = prose(r, 70), prose(r, 120)
    out = [(i, prose(r, r.randint(0, 150)), "en", f"s{i % 3}", 0) for i in range(30)]
    out += [(100 + i, base, "en", "s0", 0) for i in range(4)]
    out += [(110 + i, " ".join(base.split()[: 119 - i]) + " x", None, "s0", None) for i in range(3)]
    out += [(120 + i, prose(r, 40) + "\n" + passage + "\t" + prose(r, r.randint(0, 60)), "en", "s1", 0) for i in range(6)]
    out += [(200, None, "en", None, 0), (201, "", "en", None, 0), (202, " \n\t", "en", "s2", 0), (203, "one", "en", "s2", 0), (204, "Two words", "en", "s2", 0)]
    out += [(None, base, "en", "s1", 0), (None, None, None, None, None), (5, out[5][1], "en", "s2", 0), (5, out[5][1], "en", "s2", 0)]
    out += [(300, prose(r, 20_000), "en", "big", 0), (301, "a" * 50_000, "en", "big", 0), (302, "no " * 3000, "en", "big", 0), (-7, passage, "en", "neg", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # Names that operators use themselves.
    for c in ("fp", "copy", "size", "name", "key", "block", "passes", "shard", "gram", "seg", "start", "n", "lo", "hi", "_lo", "_row", "_id", "_key", "score", "held_out", "row", "pos", "bigram", "toxic"):
        df = df.withColumn(c, F.lit(f"mine {c}"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def same(a, b):
    key = lambda x: tuple((v is not None, v) if not isinstance(v, float) else (True, round(v, 9)) for v in x)
    assert sorted(map(key, a)) == sorted(map(key, b))


# 1


def plain_fingerprint(text):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(prints):
    n = len(prints)
    left, label = set(range(n)), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2}
            left -= near
            todo += near
        ids = [prints[i][0] for i in group if prints[i][0] is not None]
        label |= dict.fromkeys(group, min(ids) if ids else None)
    return label


@pytest.mark.parametrize("most", [simhash.NODE, 2])
def test_simhash(docs, rows, most):
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    label = plain_groups(prints)
    same([tuple(x) for x in simhash.near_duplicates(docs, most).collect()], [(i, f"{f:016x}", label[k]) for k, (i, f) in enumerate(prints)])


def test_simhash_keeps_one(docs, rows, empty):
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    label = plain_groups(prints)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = collections.Counter(label.values())
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(k for k in want if k is not None)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "a b c d", "", "", 0), (None, "a b c d", "", "", 0), (None, "q r s t u v", "", "", 0)], DOCS)
    assert simhash.keep_one(df).count() == 2
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {None}


def test_trie_pairs_random():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(3):
        x = np.concatenate([x, x ^ (np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64))])
    x = np.unique(x)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    for most in (1 << 18, 50):
        i, j = map(np.concatenate, zip(*simhash.pair_blocks(x, np.array([0]), np.array([len(x)]), 0, most=most), strict=True))
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(i) == len(got) and got == set(map(tuple, np.argwhere(np.triu(near, 1)).tolist()))


def test_forest():
    r = np.random.default_rng(2)
    for n, m in ((50, 30), (200, 150), (200, 600), (3, 0)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        member, root = simhash.forest(n, [(i[:20], j[:20]), (i[20:], j[20:])])
        label = np.arange(n)
        for _ in range(n):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        want = np.flatnonzero(label != np.arange(n))
        assert (member == want).all() and (root == label[want]).all()


def test_dense_group_is_split(spark):
    """All fingerprints in one node of the first level."""
    bits = [1 << b for b in range(20)] + [0] + [(1 << 20) | (1 << b) for b in range(21, 40)]
    df = spark.createDataFrame([(b, k) for k, b in enumerate(bits)], "fp long, doc_id long")
    found = {r.fp: r.component_id for r in simhash.groups(df, most=3).collect()}
    label = plain_groups([(k, b) for k, b in enumerate(bits)])
    assert found == {b: label[k] for k, b in enumerate(bits)}


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    r.shuffle(edges)
    root = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = collections.defaultdict(set)
    for k, v in root.items():
        groups[v].add(k)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140)), [200, 201, 202]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2


def test_quality(docs, rows, empty):
    got = quality.clean(docs).collect()
    assert len(got) == len(rows) and quality.clean(empty).count() == 0

    def plain(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    want = []
    for r in rows:
        n, *rest = plain(r[1])
        want.append((r[0], n, *rest, n < 10 or 100 * rest[-1] > 20 * n))
    same([tuple(x)[:7] for x in got], want)


@pytest.mark.parametrize(("line", "fails"), [
    ("A plain sentence of some words.", False), ("Home | News | Sport | Weather", True), ("All Rights RESERVED by the owner of this page.", True),
    ("of&&& the&&& in*** and%%% to###", True), ("Heading", True), ("Hello.", False), ("He said | so to all of them and then it went on for a while.", False),
])
def test_line_rules(line, fails):
    assert quality.line_fails(line) == fails


def test_quality_rejects_lost_text():
    good = "These are words of an ordinary line that goes on.\n"
    m = quality.measure(good * 1 + "Click here to read more and more of it.\n" * 1)
    assert m["kept"] and m["cleaned"] == good and m["n_lines_removed"] == 1
    bad = "Click here for all of it now, whatever that may be.\nOur Privacy Policy has changed again since last week.\nSign up for letters that nobody will ever open.\n"
    assert not quality.measure(good + bad)["kept"] and not quality.measure(good + bad)["base_failed"]


# 3


def plain_dedup(rows, length=50):
    first = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k : k + length])] < i:
                    gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_substring(docs, rows, monkeypatch, bits):
    monkeypatch.setattr(substring, "FILTER_BITS", bits)
    same([tuple(x) for x in substring.dedup(docs).collect()], plain_dedup([(r[0], r[1]) for r in rows]))


def test_substring_partial_overlaps(spark, empty):
    r = random.Random(9)
    text = prose(r, 400).split()
    rows = []
    for i in range(25):
        a = r.randint(0, 300)
        rows.append((i, " ".join(text[a : a + r.randint(10, 160)] + prose(r, r.randint(0, 30)).split() + text[: r.randint(0, 80)])))
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    for length in (50, 12):
        same([tuple(x) for x in substring.dedup(df, length).collect()], plain_dedup(rows, length))
    assert substring.dedup(empty).count() == 0


def test_substring_repeated_lines_edited(spark):
    r = random.Random(4)
    rows = []
    for size in (1, 6, 10, 20, 43, 60):
        for k in range(8):
            line = [f"w{size}x{k}y{j}" for j in range(size)]
            text = (line * (400 // size + 1))[:400]
            edited = list(text)
            edited[r.randint(120, 280)] = f"only{size}x{k}"
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edited))]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    for length in (50, 12):
        same([tuple(x) for x in substring.dedup(df, length).collect()], plain_dedup(rows, length))


def test_substring_recurring_gram(spark):
    """A gram that recurs in a text must not let one stretch stand for what lies between."""
    r = random.Random(6)
    head, gram, rows = prose(r, 30).split(), [f"g{j}" for j in range(8)], []
    for k in range(40):
        fill = [f"f{k}x{j}" for j in range(400)]
        parts = [w for j in range(8) for w in gram + fill[20 * j : 20 * j + 20]]
        rows += [(2 * k, " ".join(head + parts)), (2 * k + 1, " ".join(head + parts[:90] + [f"new{k}x{j}" for j in range(40)] + parts[130:]))]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    same([tuple(x) for x in substring.dedup(df).collect()], plain_dedup(rows))


def test_substring_one_id_with_two_texts(spark):
    r = random.Random(7)
    x, y = prose(r, 130), prose(r, 90)
    rows = [(1, x), (1, y), (1, x), (2, y + " " + x), (3, x[5:] + " tail"), (3, y)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    same([tuple(v) for v in substring.dedup(df).collect()], plain_dedup(rows))


def test_passages_join_neighbours():
    words = [f"{i}".encode() for i in range(300)]
    refs = [{"start": s, "n": 20, "text": b" ".join(words[s : s + 69])} for s in (0, 20, 40, 100)]
    got = list(substring._passages(refs, 50))
    assert got == [(0, 109, words[:109]), (100, 169, words[100:169])]


def test_strip(docs, rows):
    out = substring.strip(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    want = {(i, n - k) for i, n, k, _ in plain_dedup([(r[0], r[1]) for r in rows])}
    assert {(r.doc_id, len(WORD.findall(r.text or ""))) for r in out.collect()} == want


def test_automaton():
    r = random.Random(1)
    for _ in range(200):
        ref = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 30))]
        doc = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 30))]
        k = r.randint(1, 5)
        covered = {j for i in range(len(doc) - k + 1) if any(ref[m : m + k] == doc[i : i + k] for m in range(len(ref) - k + 1)) for j in range(i, i + k)}
        spans = substring.SuffixAutomaton(ref).spans(doc, k)
        assert {j for lo, hi in spans for j in range(lo, hi)} == covered


# 4


def test_chat(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "x", 6: "xy", 7: "z", 8: "z"}
    rows = [(c, k, "user" if k % 2 == 0 else "bot", t) for c, s in turns.items() for k, t in enumerate(s)]
    rows += [(None, 0, "user", "lost"), (9, 0, None, None), (10, 0, "", ""), (10, 1, "user", None), (11, None, "user", "q"), (11, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert set(got) == {2, 4, 6, 7, 9, 10, 11}
    assert got[2].n_copies == 2 and got[7].n_copies == 2 and got[11].n_turns == 2
    assert got[6].rendered == "<|user|>\nx\n<|end|>\n<|bot|>\ny\n<|end|>\n"
    assert chat.collapse(df.limit(0)).count() == 0


def test_chat_repeated_turns_and_long_ones(spark):
    r = random.Random(3)
    rows = [(c, r.choice([0, 0, 1, None]), r.choice(["user", "bot", None]), r.choice(["a", "b", "", None])) for c in range(300) for _ in range(r.randint(1, 4))]
    rows += [(1000 + c, t, "user", f"{t} " * 50_000) for c in range(2) for t in range(3 + c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("a", "b", "c", "t", "r", "k", "h1")})
    turns = collections.defaultdict(list)
    for c, *t in rows:
        turns[c].append(tuple((x is not None, x if x is not None else "") if j else (x is not None, x or 0) for j, x in enumerate(t)))
    seqs = collections.defaultdict(list)
    for c, t in turns.items():
        seqs[tuple((role, text) for _, role, text in sorted(t))].append(c)
    prefixes = {s[:k] for s in seqs for k in range(1, len(s))}
    want = [(min(c), len(s), len(c), "".join(f"<|{role[1]}|>\n{text[1]}\n<|end|>\n" for role, text in s)) for s, c in seqs.items() if s not in prefixes]
    same([tuple(x) for x in chat.collapse(df).collect()], want)


# 5


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[500:560] = x[40]  # copies, ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(700, None, 0), (720, [0.0] * 16, 0), (740, [float("nan")] * 16, 0), (760, [None] + [1.0] * 15, 0), (780, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    got = collections.defaultdict(list)
    for q in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
        assert q.rank == len(got[q.query_id])
    assert set(got) == set(range(0, 600, 20))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = y @ y[q]
        order = [k for k in np.lexsort((np.arange(600), -s.round(12))) if k != q][:20]
        hits += len({k for k, _ in found} & set(order))
        assert len(found) == 20 and q not in {k for k, _ in found}
        for (a, p), (b, t) in zip(found, found[1:], strict=False):
            assert p > t or p == t and a < b
        assert all(abs(s[k] - p) < 1e-12 for k, p in found)
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 20)")).count() == 2


def test_nearest_skewed(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 64))
    x[::3] = x[0] + 0.01 * r.normal(size=(2000, 64))  # a third in one tight group
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for q in ann.nearest(df).collect():
        got[q.query_id].add(q.vec_id)
    y, recall = x.astype(np.float64), {}
    for q in range(0, 6000, 20):
        near = y @ y[q]
        near[q] = -2
        recall[q] = len(got[q] & set(np.argsort(-near)[:20].tolist())) / 20
    assert np.mean([v for q, v in recall.items() if q % 3]) >= 0.9, np.mean([v for q, v in recall.items() if q % 3])
    assert np.mean([v for q, v in recall.items() if not q % 3]) >= 0.9, np.mean([v for q, v in recall.items() if not q % 3])


# 6


def plain_targets(sizes, weights=mixing.WEIGHTS, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = sum(sizes.values()), set()
    while True:
        opened = [s for s in names if s not in full]
        level = left / sum(w[s] for s in opened) if opened else 0
        over = [s for s in opened if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}
        full |= set(over)
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)


def test_mixing(docs, rows, empty):
    got = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    by_size = {sizes[s]: s for s in sizes}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - want[by_size[r.source_size]]) < 1e-6
        assert (r.shard >= 0) == (r.part > 0) == (r.place != "") and r.taken == r.passes * r.size + r.part
        taken[by_size[r.source_size]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2, s
    same([tuple(x) for x in got], [tuple(x) for x in mixing.plan(docs.repartition(5)).collect()])
    assert mixing.plan(empty).count() == 0 and mixing.draw(empty).count() == 0


def test_draw(docs, rows):
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    count = collections.Counter((r.doc_id, r.source) for r in drawn.collect())
    plan = collections.Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.passes + (r.part > 0 and 2 * r.part >= r.size)
    by_id = collections.Counter()
    for (i, _), n in count.items():
        by_id[i] += n
    assert by_id == +plan


def test_draw_in_small_blocks(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 100)
    dotted = docs.withColumn("n.chars", F.lit(1))
    drawn, longest, total = collections.Counter(), collections.Counter(), collections.Counter()
    for r in mixing.draw(dotted, shard_words=500).collect():
        drawn[r.source] += len(WORD.findall(r.text or ""))
    assert mixing.draw(dotted).columns == dotted.columns and mixing.draw(empty).count() == 0
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        total[r[3]], longest[r[3]] = total[r[3]] + n, max(longest[r[3]], n)
    for s, t in plain_targets(dict(total)).items():
        assert abs(drawn[s] - t) <= longest[s]


# 7


def test_segments_are_maximal():
    r = np.random.default_rng(4)
    for _ in range(100):
        s = r.integers(-3, 4, r.integers(0, 40)).astype(float)
        got = toxicity.segments(s)
        best = max([0.0] + [s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert max([0.0] + [x for _, _, x in got]) == best
        for lo, hi, x in got:
            assert x == s[lo:hi].sum() > 0
            assert all(s[lo:k].sum() > 0 for k in range(lo + 1, hi + 1)) and all(s[k:hi].sum() > 0 for k in range(lo, hi))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_toxicity(spark, docs, empty):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = prose(r, r.randint(20, 200)).split()
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["vile", "Nasty,", "wretch"]))
        rows.append((i, " ".join(words), "", "", 0))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None), (10**6, 1, 1), (0, 1, 0)]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == 1200 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == (x.doc_id % 6 == 0) for x in held) >= 0.95 * len(held)
    assert all(x.predicted == (x.score >= 0.5) and 0 <= x.score <= 1 for x in got)
    odd = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert odd[200].predicted == odd[201].predicted == 0 and odd[None].held_out is False
    clean = toxicity.reject(df, model)
    assert clean.schema == df.schema and clean.count() == sum(x.predicted == 0 for x in got)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(empty, lab.limit(0))
    assert {x.score for x in toxicity.score(df, nothing).collect()} == {0.0}


def plain_toxicity(rows, labels):
    """Scores by id, step by step over plain lists."""
    fold = lambda i, m: zlib.crc32(str(i).encode()) % m
    text, label = dict(rows), {}
    for i, t in labels:
        if i is not None and t is not None and fold(i, 5):
            label[i] = max(label.get(i, 0), int(t > 0))
    base = sum(label.values()) / len(label)
    toks = {i: [xxhash.xxh32_intdigest(w) % toxicity.BUCKETS for w in re.findall(rb"[a-z\x80-\xff]+", lower(t or "").encode())] for i, t in rows}

    def near(t):
        w = (t or "").encode().split()
        return min((xxhash.xxh64_intdigest(b" ".join(w[j : j + 5])) for j in range(max(1, len(w) - 4))), default=0)

    seen, docs_in, count = set(), [0, 0], [collections.Counter(), collections.Counter()]
    for i in sorted(i for i in label if i in text and fold(i, 5) != 4):
        c = label[i]
        if (c, near(text[i])) not in seen:
            seen.add((c, near(text[i])))
            docs_in[c] += 1
            count[c].update(set(toks[i]))
    share = [n / sum(docs_in) for n in docs_in]
    prior = [toxicity.PRIOR * x for x in share]
    score, weight = collections.defaultdict(lambda: -toxicity.DRIFT), {}
    for w in count[0].keys() | count[1].keys():
        a, b = count[0][w] + prior[0], count[1][w] + prior[1]
        d = math.log(b / a) - math.log(share[1] / share[0])
        score[w] = float(np.float32((min(max(d, -2), toxicity.MOST) if abs(d / math.sqrt(1 / a + 1 / b)) >= toxicity.LEAST_Z else 0) - toxicity.DRIFT))
        weight[w] = count[0][w] + prior[0] * (count[1][w] > 0)
    sure = sum(weight.values())
    mean = lambda r: sum(v / sure * math.exp(r * score[w]) for w, v in weight.items()) - 1
    lo, hi = 1e-3, 1.0
    while mean(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        lo, hi = ((lo + hi) / 2, hi) if mean((lo + hi) / 2) < 0 else (lo, (lo + hi) / 2)
    rate = (lo + hi) / 2
    sums = {i: [x for _, _, x in toxicity.segments(np.array([score[w] for w in t], np.float32))] for i, t in toks.items()}
    fits = sorted(i for i in label if i in text and fold(i, 5) == 4)
    top = [max(sums[i], default=0.0) for i in fits if not label[i]]
    level = float(np.median([x for x in top if x > 0])) if any(top) else 1.0
    k = math.log(max(sum(x >= level for x in top), 0.5)) - math.log(sum(len(toks[i]) * math.exp(-rate * level) for i in fits if not label[i]) + 1e-300)

    def proof(i):
        chance = max(0.0, k + math.log(max(len(toks[i]), 1)))
        return math.log1p(sum(rate * x - chance for x in sums[i] if rate * x - chance >= -math.log(toxicity.SIGNIFICANCE)))

    rich = sum(label[i] for i in fits) / len(fits)
    beta = np.zeros(2)
    for _ in range(200):
        g, h = -np.array([1e-3, 1e-2]) * beta, np.diag([1e-3, 1e-2])
        for i in fits:
            v = np.array([1.0, proof(i)])
            p, w = 1 / (1 + math.exp(-v @ beta)), base / rich if label[i] else (1 - base) / (1 - rich)
            g, h = g + w * (label[i] - p) * v, h + w * p * (1 - p) * np.outer(v, v)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if abs(step).max() < 1e-12:
            break
    return {i: 1 / (1 + math.exp(-min(30, max(-30, beta[0] + beta[1] * proof(i))))) for i, _ in rows}


def test_toxicity_is_the_plain_one_however_dealt(spark):
    r = random.Random(18)
    rows, labels = [(9999, None), (9998, "")], [(9999, 0), (9998, 0)]
    for i in range(700):
        toxic = i % 5 == 0
        words = prose(r, r.randint(5, 90)).split()
        for _ in range(r.randint(0, 5) if toxic else i % 20 == 1):
            words.insert(r.randrange(len(words)), r.choice(["vile", "Nasty,", "wretch"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, t + " more") for i, t in rows[2:60]]  # near copies
    labels += [(1000 + i, t) for i, t in labels[2:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_id", "_toxic", "toxic", "sketch", "bucket", "sums", "n", "score", "calibrates"):
        df = df.withColumn(c, F.lit(c))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    want, got = plain_toxicity(rows, labels), []
    for parts in (1, 7):
        model = toxicity.fit(df.repartition(parts, F.xxhash64("text")), lab.repartition(parts))
        got.append({x.doc_id: x.score for x in toxicity.score(df, model).collect()})
    assert got[0] == got[1]
    assert got[0].keys() == want.keys() and max(abs(got[0][i] - want[i]) for i in want) < 1e-9
    assert 0 < sum(p >= 0.5 for p in want.values()) < 200


def test_toxicity_long_clean_text(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = prose(r, r.randint(20, 200)).split()
        # Clean texts hold a stray word now and then, but never several.
        for _ in range(r.randint(2, 5) if toxic else i % 20 == 1):
            words.insert(r.randrange(len(words)), r.choice(["vile", "Nasty,", "wretch"]))
        rows.append((i, " ".join(words), "", "", 0))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    clean = " ".join(t for i, t, *_ in rows if i % 6)
    rant = " ".join(r.choice(["vile", "nasty", "wretch"]) for _ in range(12))
    [passage] = model.passages(f"{clean} {rant} {clean}".encode())[0]
    n = len(clean.split())
    assert n <= passage[0] <= n + 3 and n + 9 <= passage[1] <= n + 15  # the rant and no more than a stray word beside it
    long = [(0, clean, "", "", 0), (1, f"{clean} {clean}", "", "", 0), (2, f"{clean} {rant} {clean}", "", "", 0)]
    df = spark.createDataFrame(long, DOCS)
    assert {x.doc_id: x.predicted for x in toxicity.score(df, model).collect()} == {0: 0, 1: 0, 2: 1}
    assert {x.doc_id for x in toxicity.reject(df, model).collect()} == {0, 1}


# 8


def plain_scan(rows, threshold=licenses.THRESHOLD):
    """Every run of every text against every template."""
    table = [(n, k, licenses.normal_words(t)) for n, ts in licenses.TEMPLATES.items() for k, t in enumerate(ts)]
    out = {}
    for i, text in rows:
        words = licenses.normal_words(text or "")
        places = [None] + [" ".join(words[j : j + 2]) for j in range(len(words) - 1)]
        runs = []
        for n, k, t in table:
            known = licenses.bigrams(t)
            most = (len(t) - 1) * (2 - threshold) / threshold + 1e-9
            at = [j for j, b in enumerate(places) if b in known]
            for lo in at:
                best = (0, 0)
                same, others = set(), 0
                for hi in range(lo, len(places)):
                    if hi - lo + 1 > most:
                        break
                    if places[hi] in known:
                        same.add(places[hi])
                        best = min(best, (-2.0 * len(same) / (len(known) + others + len(same)), hi))
                    else:
                        others += 1
                if best[0] <= -threshold:
                    runs.append((best[0], lo - best[1], n, k, lo, best[1]))
        kept = []
        for r in sorted(runs):
            if all(r[4] > x[5] + 1 or x[4] > r[5] + 1 for x in kept):
                kept.append(r)
        for r in kept:
            best, count = out.get((i, r[2]), (0, 0))
            out[i, r[2]] = (max(best, -r[0]), count + 1)
    return [(i, n, d, c) for (i, n), (d, c) in out.items()]


def test_anchors_are_in_every_run():
    for t in (0.8, 0.9, 1.0):
        words = licenses.anchors(t)
        for _, _, m, need, _, found in licenses._templates(t):
            assert sum(not any(w in x for w in words for x in b.split()) for b in found) < need <= m


def test_licenses(spark, docs, empty):
    mit, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1]
    rows = [(1, "x\nReleased under the MIT License.\nmore"), (2, mit.upper()), (3, gpl.replace(",", " ,").replace("you can", "you may")), (4, "Released under the"), (5, None), (6, ""), (7, "word " * 20_000), (8, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY 4.0."), (None, "Released under CC0 1.0."), (1, "released under the mit license")]
    r = random.Random(8)
    some = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for i in range(60):  # cut, mixed up, doubled and joined notices
        parts = []
        for _ in range(r.randint(1, 5)):
            w = r.choice(some).split()
            for _ in range(r.randint(0, 6)):
                j = r.randrange(len(w))
                w[j : j + r.randint(0, 2)] = [r.choice(["the", "x", "License", "of"])] * r.randint(0, 2)
            parts.append(r.choice([" ", "\n", "\n# "]).join(w) + r.choice(["", " zz ", ". "]))
        rows.append((100 + i, " ".join(parts)))
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    same([tuple(x) for x in licenses.scan(df).collect()], plain_scan(rows))
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == 0


def test_licenses_wrapped_and_embedded(spark):
    import textwrap

    cases = [("MIT", 2), ("GPL-3.0", 1), ("GPL-2.0", 1), ("BSD-3-Clause", 1), ("MPL-2.0", 1), ("ISC", 0), ("Apache-2.0", 0), ("BSD-2-Clause", 0), ("BSD-3-Clause", 2), ("Zlib", 0)]
    r, rows, want = random.Random(2), [], []
    for i, (name, k) in enumerate(cases):
        notice = licenses.TEMPLATES[name][k]
        # No line of the notice matches alone.
        rows += [(2 * i, prose(r, 30) + "\n" + "\n".join(" * " + x for x in textwrap.wrap(notice, 40)) + "\n\n" + prose(r, 20)), (2 * i + 1, f"{prose(r, 40)} {notice} {prose(r, 40)}")]
        want += [(2 * i, name, 1.0, 1), (2 * i + 1, name, 1.0, 1)]
    twice = f"{prose(r, 9)} {licenses.TEMPLATES['MIT'][0]} {prose(r, 9)} {licenses.TEMPLATES['MIT'][0]} {prose(r, 9)}\nReleased under the MIT License."
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in [*rows, (100, twice)]], DOCS)
    same([tuple(x) for x in licenses.scan(df).collect()], [*want, (100, "MIT", 1.0, 3)])


# 9


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1 << 50), (1000, 1 << 50), (1000, 1500), (3000, 3000)):
        v = np.unique(r.integers(0, top, n).astype(np.uint64))
        e = lm.EliasFano.build(v)
        q = np.concatenate([v, r.integers(0, 2 * top, 500).astype(np.uint64), np.array([0, 1 << 62], np.uint64)])
        i, hit = e.successor(q)
        assert (hit == np.isin(q, v)).all() and (v[i[hit]] == q[hit]).all()
        if n == 1000 and top > 1500:
            assert 8 * (len(e.low) + len(e.high)) < len(v) * (3 + math.log2(top / len(v))) + 200


def test_trie_from_memory_map(tmp_path):
    r = np.random.default_rng(1)
    for words in (5, 60, 1 << 40):
        keys = np.unique(r.integers(0, words, (3000, 3)).astype(np.uint64), axis=0)
        pairs, parent = np.unique(keys[:, :2], axis=0, return_inverse=True)
        n2, n3 = r.integers(0, 3, len(pairs)).astype(float), r.integers(0, 3, len(keys)).astype(float)
        t = lm.build(pairs[:, 0], pairs[:, 1], n2, parent.reshape(-1), keys[:, 2], n3, 10_000)
        (tmp_path / "t").write_bytes(t.tobytes())
        for trie in (t, lm.Trie.open(np.memmap(tmp_path / "t", np.uint8, "r"))):
            number, code = trie.pairs(pairs[:, 0], pairs[:, 1])
            assert np.allclose(lm.frequency(code, 10_000), n2, rtol=1e-3)
            third = trie.triples(number[parent.reshape(-1)], keys[:, 2])
            assert np.allclose(lm.frequency(third, 10_000), n3, rtol=1e-3)
            known = {tuple(k) for k, n in zip(keys.tolist(), n3, strict=True) if n}
            other = r.integers(0, words, (2000, 3)).astype(np.uint64)
            number, _ = trie.pairs(other[:, 0], other[:, 1])
            assert ((trie.triples(number, other[:, 2]) > 0) == [tuple(k) in known for k in other.tolist()]).all()
    none = np.zeros(0, np.uint64)
    nothing = lm.Trie.open(lm.build(none, none, np.zeros(0), none.astype(np.int64), none, np.zeros(0), 0).tobytes())
    assert (nothing.pairs(np.arange(3, dtype=np.uint64), np.arange(3, dtype=np.uint64))[0] == -1).all()


def test_elias_fano_elements():
    r = np.random.default_rng(5)
    for n, top in ((1, 9), (1000, 1 << 50), (1000, 1500), (3000, 40)):
        v = np.sort(r.integers(0, top, n).astype(np.uint64))
        assert (lm.EliasFano.build(v).get(np.arange(n)) == v).all()


def plain_lm(rows):
    toks = [WORD.findall(lower(t or "")) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for w, h in zip(toks, held, strict=True):
        if not h:
            one.update(w)
            two.update(zip([0, *w], w, strict=False))
            three.update(zip([0, *w], w, w[1:], strict=False))
    n, v, starts = sum(one.values()), len(one), held.count(False)
    for (i, _), w, h in zip(rows, toks, held, strict=True):
        p = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        s = 0.0
        for k, x in enumerate(w):
            u = w[k - 1] if k else 0
            q = (two[u, x] + lm.MU * p[k]) / ((one[u] if k else starts) + lm.MU)
            if k:
                t = w[k - 2] if k > 1 else 0
                q = (three[t, u, x] + lm.MU * q) / (two[t, u] + lm.MU)
            s += math.log10(q)
        yield i, h, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p)), s


@pytest.mark.parametrize(("chunk", "chars"), [(lm.CHUNK, lm.SHARD_CHARS), (500, 20_000)])
def test_lm(docs, rows, empty, monkeypatch, chunk, chars):
    monkeypatch.setattr(lm, "SHARD_CHARS", chars)
    got = sorted(lm.score(docs, chunk).collect(), key=lambda x: (x.doc_id is not None, x.doc_id, x.n_tokens))
    want = sorted(plain_lm([(r[0], r[1]) for r in rows]), key=lambda x: (x[0] is not None, x[0], x[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert abs(g.base_score - w[5]) < 1e-6 and abs(g.score - w[6]) < 1e-3 * g.n_tokens
    assert lm.score(empty).count() == 0


# 10


@pytest.fixture(scope="module")
def tokens():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, tokens, empty):
    path, own = tokens
    want = []
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same([tuple(x) for x in bpe.digests(docs, path, public_tokenizers.PATTERN).collect()], want)
    full = bpe.encode(docs, path, public_tokenizers.PATTERN).where("doc_id = 204").first()
    assert bytes(full.decoded) == b"Two words" and np.frombuffer(full.ids, "<u4").tolist() == own.encode_ordinary("Two words")
    assert bpe.tokens(docs, path, public_tokenizers.PATTERN).where("not exact").count() == 0
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces(tokens):
    path, own = tokens
    t = bpe.Tokenizer(path, public_tokenizers.PATTERN)
    assert t.plain
    r = random.Random(6)
    texts = ["", "x", "  ", "\x00\x1f", "\u0085  a", "²³¼ ª", "a" * 30_000, "'s 'll 'LL", "é" * 501, "\r\n \t x  "]
    texts += ["".join(r.choice("abeé🙂 \n\t.1'²×") for _ in range(r.randint(0, 200))) for _ in range(500)]
    for s in texts:
        ids = t.encode(s)
        assert list(memoryview(ids).cast("I")) == own.encode_ordinary(s), s
        assert t.decode(ids) == s.encode()


def python_chains(df):
    """Of a plan without adaptive execution, Python operators above which the same task runs another, and all of them."""
    above, chained, every = [], 0, 0
    for line in df._jdf.queryExecution().executedPlan().treeString().splitlines():
        depth, name = re.match(r"([\s:+-]*)(?:\*\(\d+\) )?(\w*)", line).groups()
        above = [x for x in above if x[0] < len(depth)]
        if name == "MapInArrow":
            every += 1
            below = next((i for i in range(len(above), 0, -1) if above[i - 1][1] == "Exchange"), 0)
            chained += any(x[1] == name for x in above[below:])
        above.append((len(depth), name))
    return chained, every


def test_substring_tasks_hold_one_python_worker(spark, docs, monkeypatch):
    plans = []
    stored = substring.stored
    monkeypatch.setattr(substring, "stored", lambda df: (plans.append(df), stored(df))[1])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = [python_chains(x) for x in (substring.dedup(docs), substring.strip(docs), *plans)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(n for _, n in found) >= 8 and not any(n for n, _ in found)


def test_components_without_edges_run_no_python(spark):
    none = components(spark.range(3).selectExpr("id AS a", "id AS b"))
    assert none.count() == 0 and none.schema.simpleString() == "struct<node:bigint,root:bigint>"
    assert "ExistingRDD" not in none._jdf.queryExecution().executedPlan().treeString()


def test_bpe_remembers_pieces_for_a_task_only(tokens):
    t = bpe.Tokenizer(tokens[0], public_tokenizers.PATTERN)
    t.known.MOST = 2
    list(tidied(lambda batches: map(t.encode, batches))(iter(["unlikelywordx anotherwordzq", "thirdwordqx"])))
    assert not t.known and not t.known.older


def test_bpe_words_take_few_steps(tokens):
    path, own = tokens
    t = bpe.Tokenizer(path, public_tokenizers.PATTERN)
    r = random.Random(9)
    words = ["".join(r.choice("abdehinorstw") for _ in range(r.randint(6, 14))) for _ in range(200)]
    steps = 0

    def line(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return line

    before = sys.gettrace()
    sys.settrace(lambda frame, event, arg: line if frame.f_code.co_filename == bpe.__file__ else None)
    try:
        found = [t.piece(w.encode()) for w in words]
    finally:
        sys.settrace(before)
    assert found == [own.encode_ordinary(w) for w in words]
    assert steps < 15 * sum(map(len, words)), steps / sum(map(len, words))


def test_bpe_nodes_of_all_levels(tokens):
    path, own = tokens
    t = bpe.Tokenizer(path, public_tokenizers.PATTERN)
    r = random.Random(10)
    for n in [*range(1, 40), 255, 256, 257, 4095, 4096, 4097, 70_000]:
        for letters in ("aeht", "z", "é漢ß"):
            s = "".join(r.choice(letters) for _ in range(n))
            assert t.piece(s.encode()) == own.encode_ordinary(s), (n, letters)

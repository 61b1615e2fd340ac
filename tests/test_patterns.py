import random
import re

import pytest
from pyspark.sql import functions as F

from satchel.operators import manifest
from satchel.operators.patterns import Pattern, ancestors, glob_match, glob_regex, mark_unpacked, match_any, matches, pattern_table, read_patterns, select


def walk(pattern, text):
    """A backtracking matcher, for comparison."""
    if not pattern:
        return not text
    c = pattern[0]
    if c == "*":
        return any(walk(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if c == "?":
        return bool(text) and walk(pattern[1:], text[1:])
    if c == "[":
        i, negated = 1, False
        if pattern[i] in "!^":
            i, negated = 2, True
        j = pattern.index("]", i + 1)
        body, hit, k = pattern[i:j], False, 0
        while k < len(body):
            if k + 2 < len(body) and body[k + 1] == "-":
                hit |= bool(text) and body[k] <= text[0] <= body[k + 2]
                k += 3
            else:
                hit |= bool(text) and text[0] == body[k]
                k += 1
        return bool(text) and hit != negated and walk(pattern[j + 1 :], text[1:])
    if c == "\\":
        return len(pattern) > 1 and bool(text) and text[0] == pattern[1] and walk(pattern[2:], text[1:])
    return bool(text) and text[0] == c and walk(pattern[1:], text[1:])


def python(glob):
    return re.compile(glob_regex(glob).replace("\\z", "\\Z"))


def test_random_globs():
    r = random.Random(1)
    parts = ["a", "b", "/", ".", "*", "?", "[ab]", "[!a]", "[^b/]", "[a-c]", "\\*", "[]a]", "[a-]"]
    for _ in range(3000):
        p = "".join(r.choice(parts) for _ in range(r.randint(0, 5)))
        t = "".join(r.choice("abc/.*]-") for _ in range(r.randint(0, 5)))
        assert bool(python(p).match(t)) == walk(p, t), (p, t)


@pytest.mark.parametrize(("glob", "text", "want"), [
    ("*", ".a/b", True), ("*.txt", "a/b.txt", True), ("?", "é", True), ("a\\", "a", False), ("[z-a]", "m", False), ("[\\]", "\\", True), ("", "", True), ("a", "a\n", False), ("a.c", "abc", False),
])
def test_cases(spark, glob, text, want):
    assert bool(python(glob).match(text)) == want
    assert spark.createDataFrame([(text,)], "s string").select(glob_match(F.col("s"), glob, by_byte=False)).first()[0] == want


def test_bytes_and_open_sets(spark):
    d = spark.createDataFrame([("é",)], "s string")
    assert d.select(glob_match(F.col("s"), "?", by_byte=True), glob_match(F.col("s"), "??", by_byte=True)).first()[:] == (False, True)
    with pytest.raises(ValueError):
        glob_regex("[ab")


def rule(p, path):
    kind, text = p.rule()
    return path == text if kind == "equals" else bool(python(text).match(path if kind == "path" else path.rsplit("/", 1)[-1]))


def recursive(tree, exclude, include, base=""):
    """Selection by descent, for comparison with the closed form."""
    for name, below in tree.items():
        path = f"{base}/{name}" if base else name
        if any(rule(p, path) for p in exclude):
            continue
        inner = None if include is None or any(rule(p, path) for p in include) else include
        if inner is None:
            yield path
        if below is not None:
            yield from recursive(below, exclude, inner, path)


def test_selection_is_the_descent(spark):
    r = random.Random(2)

    def grow(depth):
        return {f"{r.choice('abc')}{r.choice(['', '.x', '.y'])}": grow(depth - 1) if depth and r.random() < 0.6 else None for _ in range(r.randint(1, 3))}

    def flat(t, base=""):
        for n, b in t.items():
            p = f"{base}/{n}" if base else n
            yield p
            if b is not None:
                yield from flat(b, p)

    for _ in range(12):
        t = grow(4)
        some = lambda: [Pattern(r.choice(["a*", "*.x", "b/*", "./a*", "?", "*/c*", "c.y"]), anchored=r.random() < 0.3) for _ in range(r.randint(0, 2))]  # noqa: B023, E731
        inc, exc = some(), some()
        df = spark.createDataFrame([(p,) for p in flat(t)], "path string")
        got = sorted(x.path for x in select(df, inc, exc).collect())
        assert got == sorted(recursive(t, exc, inc or None))


def test_unpacked(spark):
    df = spark.createDataFrame([("a", True, False, None), ("a/b", False, False, 3), ("c.bin", False, False, 4)], "path string, is_dir boolean, unpacked boolean, offset long")
    assert sorted(mark_unpacked(df, ["a", "*.bin"]).select("path", "unpacked", "offset").collect()) == [("a", True, None), ("c.bin", True, None)]
    assert mark_unpacked(df, []).count() == 3


def test_pattern_tables(spark, monkeypatch):
    df = spark.createDataFrame([("x/a.c",), ("b.h",), ("d",)], "path string")
    rules = pattern_table(spark.createDataFrame([("*.c/", False, False), ("d", False, True)], "pattern string, anchored boolean, literal boolean"))
    assert sorted(r.path for r in match_any(df, rules).collect()) == ["d", "x/a.c"]
    assert [r.path for r in match_any(df, rules, anti=True).collect()] == ["b.h"]
    # More literal rows than wildcards may be, repeated members, and groups of one expression each.
    monkeypatch.setattr("satchel.operators.patterns.MOST_WILDCARDS", 3)
    monkeypatch.setattr("satchel.operators.patterns.WILD_GROUP", 1)
    rows = [("*.c", False, False), ("*.h", False, False), ("./x/*", False, False)] + [(f"d{i}", False, True) for i in range(50)] + [("d", False, True), ("d", None, True)]
    many = pattern_table(spark.createDataFrame(rows, "pattern string, anchored boolean, literal boolean"))
    twice = df.unionByName(df)
    assert sorted(r.path for r in match_any(twice, many).collect()) == ["b.h", "b.h", "d", "d", "x/a.c", "x/a.c"]
    assert match_any(twice, many, anti=True).count() == 0
    plan = match_any(twice, many)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr("satchel.operators.patterns.MOST_WILDCARDS", 2)
    with pytest.raises(ValueError):
        match_any(df, many)


def test_question_mark_takes_a_byte(spark):
    df = spark.createDataFrame([("é",), ("e",), ("éé",)], "path string")
    assert [r.path for r in select(df, ["??"]).collect()] == ["é"]
    assert [r.path for r in select(df, ["?"]).collect()] == ["e"]
    assert sorted(r.path for r in select(df, ["?"], by_byte=False).collect()) == ["e", "é"]
    assert [r.path for r in select(df, ["é*é"]).collect()] == ["éé"]


def test_pattern_files(spark):
    lines = spark.createDataFrame([("  *.c \r",), ("# no",), ("",), ("dir/",)], "value string")
    assert [r.pattern for r in read_patterns(lines).collect()] == ["*.c", "dir"]


def test_no_patterns(spark):
    df = spark.createDataFrame([("a",)], "path string")
    assert df.select(matches(F.col("path"), F.col("path"), [])).first()[0] is False
    assert df.select(ancestors(F.lit("a/b/c"))).first()[0] == ["a", "a/b", "a/b/c"]


def test_running_sum_in_two_levels(spark):
    df = spark.range(0, 1000, 7).withColumn("v", F.col("id") % 13)
    got = manifest.running_before(df, F.col("v"), "id", "s", width=64).orderBy("id").collect()
    total = 0
    for r in got:
        assert r.s == total
        total += r.v

"""Shell-style patterns over members, and the selections made with them.

Patterns given as values become one boolean expression: a regular expression
for those that look at the path and one for those that look at the name. A
selection is then a plain filter, with no join and no shuffle. Of patterns in a
table, literal paths are an equality join; wildcards are counted, and a list
within a bound becomes regular expressions.

? and sets take one byte, so that a character of several needs as many.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wildcards of a pattern table, which become expressions of WILD_GROUP each.
MOST_WILDCARDS, WILD_GROUP = 100_000, 1_000


@dataclass(frozen=True)
class Pattern:
    """literal: the text is a whole path. anchored: a wildcard pattern for paths.
    Neither: a leading ./ or any / makes it one for paths, else it is for names."""

    text: str
    anchored: bool = False
    literal: bool = False

    def __post_init__(self) -> None:
        if self.text.endswith("/"):
            object.__setattr__(self, "text", self.text[:-1])

    def rule(self) -> tuple[str, str]:
        """('equals' | 'path' | 'name', text or wildcard pattern)."""
        if self.literal:
            return "equals", self.text
        if self.anchored:
            return "path", self.text
        if self.text.startswith("./"):
            return "path", self.text[2:]
        return ("path" if "/" in self.text else "name"), self.text


def patterns(values: Iterable[str | Pattern], anchored: bool = False, literal: bool = False) -> list[Pattern]:
    return [v if isinstance(v, Pattern) else Pattern(v, anchored, literal) for v in values]


def glob_regex(glob: str) -> str:
    """A regular expression for the whole string.

    * is any run, also over /; ? is one character; [a-z] and [!a-z] or [^a-z]
    are sets, where ] first is itself and a backslash is plain; elsewhere a
    backslash takes the next character as it is. An open set is an error; a
    final backslash matches nothing.
    """
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = glob[i : i + 1] in ("!", "^")
            i += negated
            start, items = i, []
            while True:
                if i >= n:
                    raise ValueError(f"open set in pattern: {glob}")
                a = glob[i]
                if a == "]" and i > start:
                    i += 1
                    break
                if glob[i + 1 : i + 2] == "-" and i + 2 < n and glob[i + 2] != "]":
                    lo, hi, step = a, glob[i + 2], 3
                    if hi == "\\" and i + 3 < n:
                        hi, step = glob[i + 3], 4
                    if lo <= hi:
                        items.append(f"{_plain(lo)}-{_plain(hi)}")
                    i += step
                else:
                    items.append(_plain(a))
                    i += 1
            body = "".join(items)
            out.append((f"[^{body}]" if negated else f"[{body}]") if body else ("." if negated else "(?!)"))
        elif c == "\\":
            out.append(_plain(glob[i]) if i < n else "(?!)")
            i += 1
        else:
            out.append(_plain(c))
    return "(?s)\\A(?:" + "".join(out) + ")\\z"


def _plain(c: str) -> str:
    """As itself in a regular expression of Java or Python, in sets too."""
    if c.isalnum() or ord(c) > 127:
        return c
    return "\\" + c if c.isprintable() else f"\\x{ord(c):02x}"


def _match_any_glob(value: Column, globs: Iterable[str], by_byte: bool) -> Column:
    """Bytes are told apart only for patterns in which they can differ from characters."""
    globs = list(dict.fromkeys(globs))
    fine = [g for g in globs if by_byte and ("?" in g or "[" in g)]
    out = []
    if plain := [g for g in globs if g not in set(fine)]:
        out.append(value.rlike("|".join(map(glob_regex, plain))))
    if fine:
        out.append(F.decode(F.encode(value, "UTF-8"), "ISO-8859-1").rlike("|".join(glob_regex(g.encode().decode("latin-1")) for g in fine)))
    return reduce(lambda a, b: a | b, out)


def glob_match(value: Column, glob: str, by_byte: bool = True) -> Column:
    """Whole-string match; by_byte counts a character of several bytes as so many for ? and sets."""
    return _match_any_glob(value, [glob], by_byte)


def matches(path: Column, name: Column, pats: Iterable[Pattern], by_byte: bool = True) -> Column:
    """Whether any pattern matches; false without patterns."""
    rules = [p.rule() for p in pats]
    out = F.lit(False)
    equal = [t for k, t in rules if k == "equals"]
    if equal:
        out = out | path.isin(equal)
    for kind, column in (("path", path), ("name", name)):
        globs = [t for k, t in rules if k == kind]
        if globs:
            out = out | _match_any_glob(column, globs, by_byte)
    return out


def ancestors(path: Column) -> Column:
    """Paths of all ancestors and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _any_ancestor(path: Column, pats: list[Pattern], by_byte: bool) -> Column:
    return F.exists(ancestors(path), lambda a: matches(a, F.substring_index(a, "/", -1), pats, by_byte))


def select(members: DataFrame, include: Iterable[str | Pattern] = (), exclude: Iterable[str | Pattern] = (), paths: Iterable[str] = (), by_byte: bool = True) -> DataFrame:
    """Members that no exclusion reaches, itself or by an ancestor, and some inclusion does.

    paths are literal inclusions. Without inclusions all are included.
    """
    take = patterns(include) + [Pattern(p, literal=True) for p in paths]
    drop = patterns(exclude)
    out = members
    if drop:
        out = out.where(~_any_ancestor(F.col("path"), drop, by_byte))
    if take:
        out = out.where(_any_ancestor(F.col("path"), take, by_byte))
    return out


def mark_unpacked(members: DataFrame, unpack: Iterable[str | Pattern], by_byte: bool = True) -> DataFrame:
    """Matching members become unpacked, without offset or content; what is below a matching directory goes."""
    pats = patterns(unpack)
    if not pats:
        return members
    hit = matches(F.col("path"), F.substring_index("path", "/", -1), pats, by_byte)
    above = F.exists(F.slice(ancestors(F.col("path")), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda a: matches(a, F.substring_index(a, "/", -1), pats, by_byte))
    out = members.where(~above).withColumn("unpacked", F.col("unpacked") | hit)
    for c in ("offset", "content"):
        if c in out.columns:
            out = out.withColumn(c, F.when(~F.col("unpacked"), F.col(c)))
    return out


def pattern_table(patterns_df: DataFrame) -> DataFrame:
    """rule ('equals', 'path' or 'name') and text, for rows (pattern, anchored, literal); one trailing / goes."""
    text = F.regexp_replace("pattern", "/$", "")
    dotted = F.startswith(text, F.lit("./"))
    literal, anchored = F.coalesce("literal", F.lit(False)), F.coalesce("anchored", F.lit(False))
    rule = F.when(literal, "equals").when(anchored | dotted | F.contains(text, F.lit("/")), "path").otherwise("name")
    body = F.when(~literal & ~anchored & dotted, F.substring(text, 3, 1 << 30)).otherwise(text)
    return patterns_df.where("pattern is not null").select(rule.alias("rule"), body.alias("text")).distinct()


def match_any(members: DataFrame, rules: DataFrame, anti: bool = False, by_byte: bool = True) -> DataFrame:
    """Members that match some row (anti: none) of a pattern_table; each row of members once.

    Literal paths, however many, are an equality join. Wildcards have no key to
    join by: they are counted, and up to MOST_WILDCARDS become filters; more
    are an error, since each of them looks at each member.
    """
    wild = rules.where("rule <> 'equals'").limit(MOST_WILDCARDS + 1).collect()
    if len(wild) > MOST_WILDCARDS:
        raise ValueError(f"more than {MOST_WILDCARDS} wildcard patterns")
    path, name = members["path"], F.substring_index(members["path"], "/", -1)
    by_rule = [(c, sorted(r.text for r in wild if r.rule == kind)) for kind, c in (("path", path), ("name", name))]
    groups = [_match_any_glob(c, texts[i : i + WILD_GROUP], by_byte) for c, texts in by_rule for i in range(0, len(texts), WILD_GROUP)]
    hit = reduce(lambda a, b: a | b, groups, F.lit(False))
    equal = rules.where("rule = 'equals'").select(F.col("text").alias("_literal")).distinct()
    if anti:
        return members.where(~F.coalesce(hit, F.lit(False))).join(equal, path == equal["_literal"], "left_anti")
    # A left join with distinct texts keeps each member once.
    return members.join(equal, path == equal["_literal"], "left").where(F.col("_literal").isNotNull() | hit).drop("_literal")


def read_patterns(lines: DataFrame) -> DataFrame:
    """pattern, from rows (value): trimmed, without blank lines and those that begin with #; one trailing / goes."""
    text = F.regexp_replace("value", "^[\\x01-\\x20]+|[ \\t-\\r]+$", "")
    return lines.select(text.alias("pattern")).where("pattern <> '' and not startswith(pattern, '#')").select(F.regexp_replace("pattern", "/$", "").alias("pattern"))

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into BLOCKS blocks of documents by a hash of the id. The
target of a source gives whole passes over all its blocks and a rest, which is
filled by blocks in a permuted order; the block where the rest ends is filled
document by document, the last document in part, so that a source's words come
out exactly. The taken blocks are the tokens of an urn with one colour a
source. The tree halves the output shards again and again: at each node a
random half of its tokens (in proportion to the shards on either side) goes
left, and a draw without replacement from colours is multivariate
hypergeometric. Then each source's permuted blocks go to the shards that hold
its tokens, disjointly, and a shard orders its documents by hash.

Only DataFrame functions run. Documents are never in one task by source: sizes
are summed by (source, block), and only the block where a rest ends is ordered
by document. Blocks and tokens are put in order in two levels, slices of the key
first, so that neither a source nor the root of the tree is one task. Only the
table of sources, a row each, is. plan() has BLOCKS blocks a source, draw()
more where they would exceed BLOCK_CHARS characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import stored

WEIGHTS = (5, 2, 1)  # by source in code-point order, null last, repeating
MOST_PASSES = 3
BLOCKS = 1024
BLOCK_CHARS = 8_000_000
SHARDS = 16


def _key(*parts: Column) -> Column:
    """A permuting key that DuckDB can compute too."""
    return F.md5(F.concat_ws("/", *parts))


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target, a row for each source; sizes: (source, size).

    The level at which shares in proportion to weights fill up all sizes, none
    above most times its source: with sources in the order of most * size /
    weight, the first that stay full are found from running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    w = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.select("*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"))
    # A source is full if the level over it and those after it would lift it above its cap.
    w = w.withColumn("full", F.col("cap") * F.col("open") < F.col("left") * F.col("weight"))
    # left / open is the level where the first source that is not full stands.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "open"))).over(everything)
    w = w.withColumn("first", first)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.left") / F.col("first.open"))
    return w.select("source", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def _before(df: DataFrame, key: Column, by: list[str], ties: list[str], value: Column) -> DataFrame:
    """df with before, the sum of value over the rows of a group that come earlier in the order of an MD5 key,
    and everything, the sum over the group. The key's first three digits cut a group into 4,096 slices."""
    marked = df.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, 3)).withColumn("_value", value)
    totals = marked.groupBy(*by, "_slice").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = totals.select(*by, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"), F.sum("_total").over(Window.partitionBy(*by)).alias("everything"))
    within = Window.partitionBy(*by, "_slice").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.join(slices, [*by, "_slice"]).withColumn("before", F.col("_earlier") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return placed.drop("_key", "_slice", "_value", "_earlier")


def _rows(docs: DataFrame, blocks: int, *more: Column) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    key = _key(F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    rows = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), name.alias("name"), key.alias("key"))
    return rows.withColumn("block", (F.conv(F.substring("key", 1, 12), 16, 10).cast("long") % blocks).cast("int"))


def _quotas(of_block: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """of_block (source, name, block, words) with source_size, target, passes, rest, before and drawn."""
    t = targets(of_block.select("source", F.col("words").alias("size")), weights, most).withColumnRenamed("source", "t_source")
    b = of_block.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    b = b.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    b = b.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
    b = _before(b, _key(F.lit("block"), F.col("name"), F.col("block").cast("string")), ["name"], ["block"], F.col("words")).drop("everything")
    return b.withColumn("drawn", F.when(F.col("before") >= F.col("rest"), "none").when(F.col("before") + F.col("words") <= F.col("rest"), "whole").otherwise("part"))


def _with_part(found: DataFrame) -> DataFrame:
    """found with part, the words of the partial pass. Only blocks where a rest ends, one a source, are ordered by document."""
    cut = found.where("drawn = 'part'")
    ordered = Window.partitionBy("name").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("name", "key")
    room = F.col("rest") - F.col("before") - (F.sum("size").over(ordered) - F.sum("size").over(alike))
    share = F.when(F.count("*").over(alike) == 1, room).otherwise(F.floor(room / F.count("*").over(alike)))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), share)).cast("long"))
    rest = found.where("drawn <> 'part'").withColumn("part", F.when(F.col("drawn") == "whole", F.col("size")).otherwise(0).cast("long"))
    return rest.unionByName(cut)


def _blocks(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    return stored(_quotas(rows.groupBy("source", "name", "block").agg(F.sum("size").alias("words")), weights, most))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken, passes,
    part (words of the last, partial pass), shard and place of that pass (-1 and empty without one).

    taken = passes * size + part. Null texts have size 0; null sources are one
    source, after all others; null ids go to one block; rows with one id in a
    source share the words that a partial pass leaves them. A source without
    words has target 0. Equal keys are ordered by the columns after them; an
    empty table gives none; very long texts are only counted. Columns other than doc_id, text and source are not read.
    """
    rows = stored(_rows(docs, blocks))
    b = _blocks(rows, weights, most)
    last = _tree(b, shards).where("last").select("name", "block", "shard")
    placed = b.join(last, ["name", "block"], "left").select("name", "block", "source_size", "target", "passes", "rest", "before", "drawn", "shard")
    out = _with_part(rows.join(placed, ["name", "block"]))
    shard = F.when(F.col("part") > 0, F.col("shard")).otherwise(-1)
    place = F.when(F.col("part") > 0, _key(F.lit("place"), F.col("key"))).otherwise("")
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"), "passes", "part", shard.alias("shard"), place.alias("place"))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, blocks: int = BLOCKS, shard_words: int = 5_000_000) -> DataFrame:
    """The mix itself: rows of docs, unchanged, once for each pass, in the shards' order.

    Whole documents only: the one document of a source that plan() takes in part
    is in the last pass if that part is half of it or more. Documents without
    words come with the whole passes of their source. Nulls, repeated rows and
    empty tables as in plan(); columns may have any names. A shard of about
    shard_words words is sorted in one task, a very long text makes it longer.
    """
    small = 100_000  # rows of the block table that are broadcast; beyond, both sides are shuffled
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(blocks, 1 + int(chars // BLOCK_CHARS))
    rows = _rows(docs, blocks, F.struct("*").alias("_row"))
    b = _blocks(rows.drop("_row"), weights, most)
    size = b.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    tokens = stored(_tree(b, 1 + int(size.words // shard_words)))
    shrink = F.broadcast if size.n * (most + 1) <= small else lambda x: x
    found = _with_part(rows.join(shrink(b.select("name", "block", "passes", "rest", "before", "drawn")), ["name", "block"]))
    copies = F.col("passes") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")
    each = found.where(copies > 0).select("_row", "name", "block", "key", F.explode(F.sequence(F.lit(1), copies)).alias("pass"))
    placed = each.join(shrink(tokens.select("name", "block", "pass", "shard")), ["name", "block", "pass"])
    place = _key(F.lit("place"), F.col("pass").cast("string"), F.col("key"))
    return placed.withColumn("place", place).repartition("shard").sortWithinPartitions("shard", "place").select("_row.*")


def _tree(blocks: DataFrame, shards: int) -> DataFrame:
    """name, block, pass, last (the partial pass), shard. The urn's tokens, one for each block and pass, are
    split over a binary tree of shards; then the n-th block of a source takes its n-th token."""
    passes = F.col("passes") + (F.col("drawn") != "none").cast("int")
    tokens = blocks.where(passes > 0).select("name", "block", F.explode(F.sequence(F.lit(1), passes)).alias("pass"), "passes")
    key = _key(F.lit("draw"), F.col("name"), F.col("block").cast("string"), F.col("pass").cast("string"))
    t = _before(tokens, key, ["name"], ["block", "pass"], F.lit(1))
    t = stored(t.select("name", "block", "pass", (F.col("pass") > F.col("passes")).alias("last"), (F.col("before") + 1).cast("int").alias("n")))
    urn = t.select("name", "n", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    for depth in range((shards - 1).bit_length()):
        at = _before(urn, _key(F.lit(f"level {depth}"), F.col("name"), F.col("n").cast("string")), ["lo", "hi"], ["name", "n"], F.lit(1))
        mid, wide = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"), F.col("hi") - F.col("lo") > 1
        split = at.select("*", mid.alias("mid"), (wide & ((F.col("before") + 1) * (F.col("hi") - F.col("lo")) <= F.col("everything") * (mid - F.col("lo")))).alias("left"))
        urn = split.select("name", "n", F.when(~wide | F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(F.col("left"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        if depth % 4 == 3:
            urn = stored(urn)  # keeps the plan short
    return t.join(urn.select("name", "n", F.col("lo").alias("shard")), ["name", "n"]).select("name", "block", "pass", "last", "shard")


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, blocks: int = BLOCKS, shards: int = SHARDS) -> str:
    """DuckDB SQL for plan() of documents."""
    w = ", ".join(map(str, weights))
    levels, last = [], "u0"
    for d in range((shards - 1).bit_length()):
        levels.append(f"""s{d} AS (SELECT *, (lo + hi) // 2 AS mid, hi - lo > 1 AND row_number() OVER (PARTITION BY lo, hi ORDER BY md5('level {d}/' || name || '/' || n), name, n) * (hi - lo)
  <= count(*) OVER (PARTITION BY lo, hi) * ((lo + hi) // 2 - lo) AS lft FROM {last}),
u{d + 1} AS (SELECT name, n, CASE WHEN hi - lo <= 1 OR lft THEN lo ELSE mid END AS lo, CASE WHEN lft THEN mid ELSE hi END AS hi FROM s{d})""")
        last = f"u{d + 1}"
    return rf"""
WITH r AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce('=' || source, '-') AS name, md5('doc/' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents),
rows_ AS (SELECT *, CAST(CAST('0x' || key[1:12] AS BIGINT) % {blocks} AS INTEGER) AS block FROM r),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
w AS (SELECT *, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight, source_size * {most} AS cap FROM src),
x AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS BIGINT) AS lft, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS opn
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, cap * opn < lft * weight AS is_full FROM x),
f AS (SELECT lft AS f_left, opn AS f_open FROM y WHERE NOT is_full ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * f_left / f_open END, CAST(cap AS DOUBLE)) AS target FROM y LEFT JOIN f ON true),
ob AS (SELECT source, name, block, CAST(sum(size) AS BIGINT) AS words FROM rows_ GROUP BY ALL),
b0 AS (SELECT ob.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(least({most}, floor(target / source_size)) AS INTEGER) ELSE 0 END AS passes
  FROM ob JOIN t ON ob.source IS NOT DISTINCT FROM t.source),
b1 AS (SELECT *, CAST(round(target) AS BIGINT) - passes * source_size AS rest, CAST(coalesce(sum(words) OVER (PARTITION BY name
  ORDER BY md5('block/' || name || '/' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b0),
b AS (SELECT *, CASE WHEN before >= rest THEN 'none' WHEN before + words <= rest THEN 'whole' ELSE 'part' END AS drawn FROM b1),
tk AS (SELECT name, block, passes, unnest(range(1, passes + CAST(drawn <> 'none' AS INTEGER) + 1)) AS pass FROM b),
tok AS (SELECT name, block, pass > passes AS is_last, row_number() OVER (PARTITION BY name ORDER BY md5('draw/' || name || '/' || block || '/' || pass), block, pass) AS n FROM tk),
u0 AS (SELECT name, n, 0 AS lo, {shards} AS hi FROM tok),
{", ".join(levels)},
placed AS (SELECT b.*, {last}.lo AS shard FROM b LEFT JOIN tok ON b.name = tok.name AND b.block = tok.block AND tok.is_last LEFT JOIN {last} ON tok.name = {last}.name AND tok.n = {last}.n),
found AS (SELECT rows_.doc_id, rows_.size, rows_.key, p.* FROM rows_ JOIN placed p ON rows_.name = p.name AND rows_.block = p.block),
cut AS (SELECT *, rest - before - (sum(size) OVER (PARTITION BY name ORDER BY key) - sum(size) OVER (PARTITION BY name, key)) AS room, count(*) OVER (PARTITION BY name, key) AS alike FROM found WHERE drawn = 'part'),
parts AS (SELECT doc_id, size, source_size, target, passes, shard, key, CAST(greatest(0, least(size, CASE WHEN alike = 1 THEN room ELSE floor(room / alike) END)) AS BIGINT) AS part FROM cut
  UNION ALL SELECT doc_id, size, source_size, target, passes, shard, key, CASE WHEN drawn = 'whole' THEN size ELSE 0 END FROM found WHERE drawn <> 'part')
SELECT doc_id, size, source_size, target, passes * size + part AS taken, passes, part, CASE WHEN part > 0 THEN shard ELSE -1 END AS shard,
  CASE WHEN part > 0 THEN md5('place/' || key) ELSE '' END AS place FROM parts
"""

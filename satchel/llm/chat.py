"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation many times, each snapshot a few turns longer. A
rolling hash of the turns so far identifies every prefix of every conversation;
a conversation whose whole hash is a prefix of a longer one goes by anti-join,
and of equal conversations the one with the least id stays. Only those left
are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import stored

#: Rendering of a turn; role and text are substituted.
START, MIDDLE, END = "<|", "|>\n", "\n<|end|>\n"


SECOND = "second"  # seed of the second hash


def _hash(*parts: Column) -> Column:
    """A hash in which nulls differ from empty strings."""
    return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts))


def _source(conversations: DataFrame) -> DataFrame:
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    return conversations.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())).where("conv_id is not null")


def _positions(src: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b): places and hashes of turns. Texts do not leave their task, but
    for turns that repeat with their role, which are ordered by text."""
    hashed = src.select("conv_id", "turn", "role", _hash(F.col("role"), F.col("text")).alias("a"), _hash(F.lit(SECOND), F.col("role"), F.col("text")).alias("b"), "text")
    tied = stored(hashed.groupBy("conv_id", "turn", "role").count().where("count > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r")))
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("role").eqNullSafe(F.col("r"))
    alone = hashed.drop("text").join(tied, same, "left_anti").withColumn("k", F.lit(1))
    by_text = Window.partitionBy("conv_id", "turn", "role").orderBy(F.col("text").asc_nulls_first())
    repeated = hashed.join(tied, same, "left_semi").withColumn("k", F.row_number().over(by_text)).drop("text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "k")
    return alone.unionByName(repeated).select("conv_id", F.row_number().over(order).alias("pos"), "a", "b")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay; turns: (conv_id, pos, a, b)."""
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy("conv_id")
    rolled = turns.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("h1"), F.xxhash64(F.lit(SECOND), "pos", "a", "b").alias("h2"))
    rolled = rolled.select(
        "conv_id", "pos", F.expr("bit_xor(h1)").over(so_far).alias("h1"), F.expr("bit_xor(h2)").over(so_far).alias("h2"), F.max("pos").over(all_of).alias("n")
    )
    rolled = stored(rolled)
    whole = rolled.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # One row a prefix, combined on the map side: a first turn that a third of all logs share costs a row a task.
    longer = rolled.where("pos < n").groupBy("pos", "h1", "h2").agg(F.max("n").alias("longest")).select(F.col("pos").alias("n"), "h1", "h2")
    return whole.join(longer, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(src: DataFrame) -> DataFrame:
    """conv_id, rendered: the turns in order, each as <|role|>, text and <|end|>; src: (conv_id, turn, role, text)."""
    line = lambda x: F.concat(F.lit(START), F.coalesce(x["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(x["text"], F.lit("")), F.lit(END))
    # Fields of a struct sort with nulls first.
    in_order = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return src.groupBy("conv_id").agg(F.array_join(F.transform(in_order, line), "").alias("rendered"))


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered, a row for each maximal conversation.

    Turns are ordered by (turn, role, text), nulls first; repeated rows are
    turns of their own. A null role or text renders as empty but is not equal to
    an empty one. Rows without conv_id belong to no conversation and are left
    out. Equal conversations count as copies of the least id; other columns are
    not read. An empty table gives none. One task hashes and renders a whole
    conversation, however long.
    """
    src = _source(conversations)
    kept = stored(maximal(_positions(src)))
    return kept.join(render(src.join(kept.select("conv_id"), "conv_id", "left_semi")), "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")


ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-') AS v, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS line
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list(v ORDER BY pos) AS vs, string_agg(line, '' ORDER BY pos) AS rendered FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n, vs, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY n, vs),
p AS (SELECT DISTINCT vs[1:k] AS vs FROM u, LATERAL (SELECT unnest(range(1, n)) AS k))
SELECT conv_id, n AS n_turns, n_copies, rendered FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.vs = u.vs)
"""

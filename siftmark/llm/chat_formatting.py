"""Cumulative-snapshot collapse of logged conversations, and their rendering (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import durable, read

_TURN = ("turn", "role", "text")


def _order(names: tuple[str, ...]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """Each turn with its place k, the number n of its conversation's turns, and the hash of turns 1..k.

    The hash is 128 bits wide: two running xor sums of place-keyed turn hashes,
    so a window over a conversation extends it by one turn at a time. Exactly
    repeated rows of a conversation count once; equal turn numbers are ordered
    by role, then text; nulls come first and differ from empty strings. Rows
    without conv_id form one conversation. Other columns are not used.
    """
    rows = conversations.select("conv_id", *_TURN)
    ordered = Window.partitionBy("conv_id").orderBy(*_order(_TURN))
    same = F.lit(True)
    for c in _TURN:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(ordered))
    whole = Window.partitionBy("conv_id")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return (
        rows.withColumn("first", (F.row_number().over(ordered) == 1) | ~same)
        .where("first")
        .withColumn("k", F.row_number().over(ordered))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("prefix_a", F.bit_xor(F.xxhash64("k", *turn)).over(running))
        .withColumn("prefix_b", F.bit_xor(F.xxhash64(F.lit("second"), *turn, F.col("k"))).over(running))
        .select("conv_id", "role", "text", "k", "n", "prefix_a", "prefix_b")
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n, n_copies) of conversations that are no proper prefix of another; of equal ones the smallest conv_id stays."""
    key = ["n", "prefix_a", "prefix_b"]
    whole = turns.where("k = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = turns.where("k < n").select(F.col("k").cast("long").alias("n"), "prefix_a", "prefix_b").distinct()
    return whole.join(shorter, key, "left_anti").select("conv_id", "n", "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One text per kept conversation, with <|im_start|> and <|im_end|> around the turns.

    Inside turns `<|` becomes `< |`, so no text can forge a marker. A null
    role is written `unknown`, a null text as nothing.
    """
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    name = F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    part = F.concat(F.lit("<|im_start|>"), name, F.lit("\n"), body, F.lit("<|im_end|>\n"))
    there = F.col("kept.conv_id").eqNullSafe(F.col("turns.conv_id"))
    return (
        turns.alias("turns")
        .join(kept.alias("kept"), there)
        .select("turns.conv_id", "kept.n", "kept.n_copies", "k", part.alias("part"))
        .groupBy("conv_id")
        .agg(F.first("n").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("rendered"))
        .withColumn("n_chars", F.length("rendered").cast("long"))
    )


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, rendered, n_chars. An empty table gives none."""
    turns = durable(turn_prefixes(conversations))
    return render(turns, maximal_conversations(turns))


def op5_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_snapshots(read(spark, sf_dir, "conversations"))


SQL = {
    "op5_chat_snapshot_collapse": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t),
c AS (SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY k) AS xs FROM r GROUP BY conv_id),
d AS (SELECT n, xs, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY n, xs),
p AS (SELECT DISTINCT xs[1:k] AS xs FROM (SELECT xs, unnest(range(1, n)) AS k FROM d))
SELECT conv_id, n AS n_turns, n_copies, rendered, length(rendered) AS n_chars FROM (
  SELECT conv_id, n, n_copies, array_to_string(list_transform(xs, lambda x: '<|im_start|>' || replace(coalesce(x.role, 'unknown'), '<|', '< |')
    || chr(10) || replace(coalesce(x.text, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') AS rendered
  FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.xs = d.xs))
"""
}
QUERIES = {"op5_chat_snapshot_collapse": op5_chat_snapshot_collapse}

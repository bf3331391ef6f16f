"""Differences of pairs of long texts, over many tasks.

Short pairs' scripts are found whole, many pairs to a task. Of longer ones
lines that are found just once on either side are anchors; the longest run of
them that rises on both sides is kept, and cuts the pair into gaps. Lines that
are unique within a gap cut it again. Then each gap's script is found by
itself. Lines go by their MD5 once they are numbered, so no task holds texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import kept
from .diff import blocks, edit_script

PAIR = ("assignment_id", "a", "b")
#: Lines that are numbered within one window; times that gaps are cut anew; rows of gaps that Python takes at once.
BLOCK, ROUNDS, GAP_ROWS = 4096, 3, 20_000
_SCRIPT = "assignment_id string, a long, b long, kind string, i long, j long"
#: Lines that either side of a pair may have whose script is found whole, and such pairs that Python takes at once.
SHORT, PAIRS_AT_ONCE = 200, 500
_OPS = "assignment_id string, a long, b long, op_no int, type string, a_start int, a_end int, b_start int, b_end int"


def longest_rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of (i, j), given by rising i, whose j rise too."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(places):
        p = bisect_left(tails, j)
        before.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(places[k])
        k = before[k]
    return out[::-1]


def numbered_lines(texts: DataFrame, key: Column | None = None) -> DataFrame:
    """assignment_id, submission_id, no (from 0), line of texts (assignment_id, submission_id, text): each line named by the MD5 of its key, trimmed as it is by default. A null text is one empty line."""
    lines = texts.select("assignment_id", "submission_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("no", "line"))
    return lines.withColumn("no", F.col("no").cast("long")).withColumn("line", F.md5(F.trim("line") if key is None else key))


def _anchors(sides: DataFrame) -> DataFrame:
    """PAIR, gap, i, j of the lines that a gap has once on either side."""
    once = sides.groupBy(*PAIR, "gap", "line").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"), F.max(F.when(F.col("side") == "a", F.col("no"))).alias("i"), F.max(F.when(F.col("side") == "b", F.col("no"))).alias("j"))
    return once.where("n_a = 1 AND n_b = 1").select(*PAIR, "gap", "i", "j")


def _by_gap(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each gap by themselves, sorted by their line."""
    rows = rows.sort_values(["gap", "no"], kind="stable")
    cuts = np.flatnonzero((rows["gap"].to_numpy()[1:] != rows["gap"].to_numpy()[:-1])) + 1
    for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        yield rows.iloc[i:j]


def _bundle(n_rows: int) -> Column:
    """Gaps that one call of Python takes together: a number that about GAP_ROWS of so many rows share."""
    return F.pmod(F.xxhash64("gap"), F.lit(n_rows // GAP_ROWS + 1)).alias("bundle")


def _rising(anchors: DataFrame) -> DataFrame:
    """The longest rising run of each gap's anchors. A gap's only anchor rises by itself, so Python sees the others alone."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for gap in _by_gap(rows.rename(columns={"i": "no"})):
            chosen = {i for i, _ in longest_rising(list(zip(gap["no"].tolist(), gap["j"].tolist(), strict=True)))}
            taken.append(gap[gap["no"].isin(chosen)])
        return pd.concat(taken).rename(columns={"no": "i"})[["assignment_id", "a", "b", "gap", "i", "j"]]

    counted = kept(anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "gap"))))
    several = counted.where("n > 1").drop("n")
    chosen = several.groupBy(*PAIR, _bundle(several.count())).applyInPandas(choose, "assignment_id string, a long, b long, gap string, i long, j long")
    return counted.where("n = 1").drop("n").unionByName(chosen)


def _cut(sides: DataFrame, anchors: DataFrame) -> DataFrame:
    """sides without the anchors' lines, each gap split where an anchor was.

    A line's part is the number of anchors before it: those of the blocks of
    lines before its own, and those of its block. So a long side is numbered
    by as many tasks as it has blocks.
    """
    cuts = anchors.select(*PAIR, "gap", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("i").alias("no")), F.struct(F.lit("b").alias("side"), F.col("j").alias("no")))).alias("x")).select(*PAIR, "gap", "x.side", "x.no", F.lit(1).alias("anchor"))
    key = [*PAIR, "gap", "side"]
    rows = sides.join(cuts, [*key, "no"], "left").withColumn("block", F.floor(F.col("no") / BLOCK))
    blocks = cuts.groupBy(*key, F.floor(F.col("no") / BLOCK).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    upto = blocks.withColumn("n", F.sum("n").over(Window.partitionBy(*key).orderBy("of").rowsBetween(Window.unboundedPreceding, 0)))
    # for every block of lines the anchors before it: those up to the last block below that has any
    spans = rows.select(*key, "block").distinct().join(upto.withColumn("next", F.lead("of").over(Window.partitionBy(*key).orderBy("of"))), key, "left").where("of IS NULL OR of < block AND (next IS NULL OR next >= block)")
    start = rows.select(*key, "block").distinct().join(spans.select(*key, "block", F.coalesce("n", F.lit(0)).alias("start")), [*key, "block"], "left")
    inside = F.sum(F.coalesce("anchor", F.lit(0))).over(Window.partitionBy(*key, "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    part = F.coalesce("start", F.lit(0)) + F.coalesce(inside, F.lit(0))
    named = rows.join(start, [*key, "block"]).withColumn("gap", F.concat("gap", F.lit("."), F.lpad(part.cast("string"), 12, "0")))
    return named.where("anchor IS NULL").select(*PAIR, "gap", "side", "no", "line")


def _scripts(sides: DataFrame) -> DataFrame:
    """_SCRIPT of every gap by itself. Where a gap has lines of one side alone they are all deleted, or inserted; Python sees the others."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        first, out = rows.iloc[0], []
        for gap in _by_gap(rows):
            of_a = (gap["side"] == "a").to_numpy()
            no, line = gap["no"].to_numpy(), gap["line"].to_numpy()
            i, j = no[of_a].tolist(), no[~of_a].tolist()
            script = edit_script(line[of_a].tolist(), line[~of_a].tolist())
            out += [(kind, i[p] if p >= 0 else None, j[q] if q >= 0 else None) for kind, p, q in script]
        found = pd.DataFrame(out, columns=["kind", "i", "j"]).astype({"i": "Int64", "j": "Int64"})
        return found.assign(assignment_id=first["assignment_id"], a=first["a"], b=first["b"])[["assignment_id", "a", "b", "kind", "i", "j"]]

    both = F.max("side").over(Window.partitionBy(*PAIR, "gap")) != F.min("side").over(Window.partitionBy(*PAIR, "gap"))
    flagged = kept(sides.withColumn("both", both), 16)
    mixed = flagged.where("both")
    found = mixed.groupBy(*PAIR, _bundle(mixed.count())).applyInPandas(go, _SCRIPT)
    alone = flagged.where("NOT both")
    of_a = F.col("side") == "a"
    return found.unionByName(alone.select(*PAIR, F.when(of_a, "delete").otherwise("insert").alias("kind"), F.when(of_a, F.col("no")).alias("i"), F.when(~of_a, F.col("no")).alias("j")))


def line_script(pairs: DataFrame, lines: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """PAIR, kind (equal, delete, insert), i, j of every line of pairs (PAIR), of lines as numbered_lines() gives them.

    A valid script, not always a shortest one: lines that moved may be anchors.
    """
    side = lambda s: pairs.select(*PAIR).join(lines.select("assignment_id", F.col("submission_id").alias(s), "no", "line"), ["assignment_id", s]).select(*PAIR, F.lit("").alias("gap"), F.lit(s).alias("side"), "no", "line")
    sides = kept(side("a").unionByName(side("b")), 16)
    found: list[DataFrame] = []
    for _ in range(rounds):
        anchors = kept(_rising(_anchors(sides)))
        if anchors.isEmpty():
            break
        found.append(anchors.select(*PAIR, F.lit("equal").alias("kind"), "i", "j"))
        sides = kept(_cut(sides, anchors), 16)
    out = _scripts(sides)
    for anchors in found:
        out = out.unionByName(anchors)
    return out


def _short_ops(pairs: DataFrame) -> DataFrame:
    """_OPS of pairs (PAIR, lines_a, lines_b), each script found whole."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OPS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 4]
        for whole in batches:
            for at in range(0, len(whole), PAIRS_AT_ONCE):
                rows = []
                for assignment, a, b, x, y in zip(*(c.to_pylist() for c in whole.slice(at, PAIRS_AT_ONCE).columns), strict=True):
                    for no, (kind, i, j) in enumerate(blocks(edit_script(x, y))):
                        rows.append((assignment, a, b, no, kind, *((i[0] + 1, i[-1] + 1) if i else (None, None)), *((j[0] + 1, j[-1] + 1) if j else (None, None))))
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pairs.select(*PAIR, "lines_a", "lines_b").mapInArrow(go, _OPS)


def long_diff(pairs: DataFrame, lines: DataFrame, rounds: int = ROUNDS, short: int = SHORT) -> DataFrame:
    """assignment_id, a, b, op_no, type, a_start, a_end, b_start, b_end (lines from 1) of pairs (PAIR): blocks as pair_diff() has them; a deletion and the insertion after it are a modification.

    A pair with at most short lines on either side gets a shortest script, in
    one call; others the script of line_script(). No array has more lines than
    short.
    """
    first = F.collect_list(F.when(F.col("no") < short, F.struct("no", F.unhex("line").alias("line"))))
    texts = kept(lines.groupBy("assignment_id", "submission_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(first), lambda x: x["line"]).alias("lines")))
    side = lambda s: texts.select("assignment_id", F.col("submission_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("lines").alias(f"lines_{s}")).hint("merge")
    both = pairs.select(*PAIR).join(side("a"), ["assignment_id", "a"]).join(side("b"), ["assignment_id", "b"])
    few = (F.col("n_a") <= short) & (F.col("n_b") <= short)
    long = kept(both.where(~few).select(*PAIR))
    found = _short_ops(both.where(few))
    return found if long.isEmpty() else found.unionByName(_long_ops(long, lines, rounds))


def _long_ops(pairs: DataFrame, lines: DataFrame, rounds: int) -> DataFrame:
    """_OPS of line_script()."""
    script = line_script(pairs, lines, rounds)
    # an inserted line stands after the last line of a that is equal to one before it
    pair = Window.partitionBy(*PAIR)
    by_b = pair.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    with_b = script.where("j IS NOT NULL").withColumn("after", F.coalesce(F.max("i").over(by_b), F.lit(-1).cast("long")))
    placed = with_b.select(*PAIR, "kind", "i", "j", F.coalesce("i", F.col("after")).alias("x")).unionByName(script.where("j IS NULL").select(*PAIR, "kind", "i", "j", F.col("i").alias("x")))
    # deletions between two equal lines come before the insertions there
    equal_before = F.max(F.when(F.col("kind") == "equal", F.col("i"))).over(pair.orderBy("x", "rank", "j").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("rank", F.when(F.col("kind") == "insert", 1).otherwise(0))
    stretch = ranked.withColumn("stretch", F.coalesce(equal_before, F.lit(-1).cast("long")))
    order = pair.orderBy("stretch", F.when(F.col("kind") == "equal", 0).when(F.col("kind") == "delete", 1).otherwise(2), "i", "j")
    islands = stretch.withColumn("fresh", F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1))).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*PAIR, "island").agg(F.first("kind").alias("kind"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    seq = pair.orderBy("island")
    after, before = (lambda c: F.lead(c).over(seq)), (lambda c: F.lag(c).over(seq))
    joined = merged.select(*PAIR, "island", "kind", "i0", "i1", "j0", "j1", after("kind").alias("next"), after("j0").alias("nj0"), after("j1").alias("nj1"), before("kind").alias("prev"))
    modified = (F.col("kind") == "delete") & F.coalesce(F.col("next") == "insert", F.lit(False))
    left = joined.where(~((F.col("kind") == "insert") & F.coalesce(F.col("prev") == "delete", F.lit(False))))
    number = F.row_number().over(pair.orderBy("island")) - 1
    one = lambda c: (c + 1).cast("int")
    return left.select(*PAIR, number.alias("op_no"), F.when(modified, "modify").otherwise(F.col("kind")).alias("type"), one(F.col("i0")).alias("a_start"), one(F.col("i1")).alias("a_end"), one(F.when(modified, F.col("nj0")).otherwise(F.col("j0"))).alias("b_start"), one(F.when(modified, F.col("nj1")).otherwise(F.col("j1"))).alias("b_end"))

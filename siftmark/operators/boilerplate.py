"""Boilerplate: hashes of starter code, or of most submissions of an assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import kept
from .pairs import merged, pair_counts

# Share of submissions from which a hash is boilerplate, and the least number of submissions for that.
THRESHOLD, LEAST = 0.7, 3


def hash_frequency(sets: DataFrame, submissions: DataFrame, many: bool = False) -> DataFrame:
    """assignment_id, hash, occurrences, total, frequency; total counts all submissions, also those without fingerprints. many: the assignments are as many as submissions, so their totals aren't sent to every task."""
    totals = submissions.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("total"))
    counts = sets.groupBy("assignment_id", "hash").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(merged(totals) if many else totals, "assignment_id").select("assignment_id", "hash", "occurrences", "total", (F.col("occurrences") / F.col("total")).alias("frequency"))


def boilerplate_stats(frequency: DataFrame, starter: DataFrame | None = None, threshold: float | None = THRESHOLD) -> DataFrame:
    """frequency with is_boilerplate: in LEAST submissions and the threshold's share at least, or a starter hash (hash)."""
    limit = F.lit(float(THRESHOLD if threshold is None else threshold))
    needed = F.greatest(F.lit(LEAST), F.ceil(F.col("total").cast("double") * limit))
    often = (F.col("total") >= LEAST) & (F.col("occurrences") >= needed)
    if starter is None:
        return frequency.withColumn("is_boilerplate", often)
    known = starter.select("hash").distinct().withColumn("starter", F.lit(True))
    return frequency.join(known, "hash", "left").withColumn("is_boilerplate", often | F.coalesce("starter", F.lit(False))).select(*frequency.columns, "is_boilerplate")


def summary(stats: DataFrame) -> DataFrame:
    """assignment_id, n_hashes, n_boilerplate."""
    return stats.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("n_hashes"), F.count_if("is_boilerplate").alias("n_boilerplate"))


def without_boilerplate(sets: DataFrame, stats: DataFrame) -> DataFrame:
    """The sets' rows whose hash is no boilerplate of their assignment."""
    return sets.join(stats.where("is_boilerplate").select("assignment_id", "hash"), ["assignment_id", "hash"], "left_anti")


def only_boilerplate(sets: DataFrame, stats: DataFrame) -> DataFrame:
    """The sets' rows whose hash is boilerplate of their assignment."""
    return sets.join(stats.where("is_boilerplate").select("assignment_id", "hash"), ["assignment_id", "hash"], "left_semi")


def adjusted_pairs(sets: DataFrame, stats: DataFrame) -> DataFrame:
    """assignment_id, a, b, shared, raw, adjusted, overlap, n_boilerplate, n_clean of all pairs with a common hash.

    adjusted leaves boilerplate out of both sets (0 if nothing is left);
    overlap is the share of common boilerplate in the union.
    """
    flags = stats.select("assignment_id", "hash", "is_boilerplate")
    flagged = kept(sets.join(flags.hint("merge"), ["assignment_id", "hash"]))
    joined = pair_counts(flagged, flags=["is_boilerplate"]).withColumnRenamed("n_is_boilerplate", "n_boilerplate")
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    n_clean = F.col("shared") - F.col("n_boilerplate")
    clean = lambda side: F.col(f"size_{side}") - F.col(f"own_is_boilerplate_{side}")
    rest = clean("a") + clean("b") - n_clean
    return joined.select(
        "assignment_id", "a", "b", "shared", (F.col("shared") / union).alias("raw"), F.when(rest == 0, F.lit(0.0)).otherwise(n_clean / rest).alias("adjusted"),
        (F.col("n_boilerplate") / union).alias("overlap"), "n_boilerplate", n_clean.alias("n_clean"),
    )

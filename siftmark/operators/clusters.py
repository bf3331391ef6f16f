"""Clusters of similar submissions: connected components of pairs above a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import kept


def cluster_edges(pairs: DataFrame, threshold: float = 0.5, score: str = "adjusted") -> DataFrame:
    """assignment_id, a, b, score of pairs of different submissions with the threshold's score at least; a null score counts as 0."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    return pairs.where((value >= threshold) & (F.col("a") != F.col("b"))).select("assignment_id", "a", "b", value.alias("score"))


def clusters(edges: DataFrame) -> DataFrame:
    """assignment_id, submission_id, cluster_id: the smallest submission_id that edges reach within the assignment.

    Every round a node takes the least label of its neighbours, then the
    label of its label, so a chain halves; rounds are kept in the checkpoint
    folder, and the driver sees only whether a label changed.
    """
    key = ["assignment_id"]
    both = kept(edges.select(*key, "a", "b").union(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(*key, F.col("a").alias("submission_id")).agg(F.least(F.min("a"), F.min("b")).alias("cluster_id"))
    labels = kept(labels)
    while True:
        near = both.join(labels.select(*key, F.col("submission_id").alias("b"), "cluster_id"), [*key, "b"]).groupBy(*key, F.col("a").alias("submission_id")).agg(F.min("cluster_id").alias("near"))
        spread = labels.join(near, [*key, "submission_id"]).select(*key, "submission_id", F.col("cluster_id").alias("old"), F.least("cluster_id", "near").alias("cluster_id"))
        own = labels.select(*key, F.col("submission_id").alias("cluster_id"), F.col("cluster_id").alias("further"))
        now = kept(spread.join(own, [*key, "cluster_id"]).select(*key, "submission_id", "old", F.least("cluster_id", "further").alias("cluster_id")))
        labels = now.drop("old")
        if not now.where("old <> cluster_id").limit(1).count():
            return labels


def cluster_stats(members: DataFrame, edges: DataFrame, submissions: DataFrame) -> DataFrame:
    """assignment_id, cluster_id, size, average, highest, best_a, best_b, members, students, within_minutes of each cluster.

    best is the highest pair, of equal ones the smallest. A member without a
    student_id is named after its submission. within_minutes is the rounded
    time between the first and the last submission if two or more have one.
    """
    by_a = members.withColumnRenamed("submission_id", "a")
    scores = edges.join(by_a, ["assignment_id", "a"]).groupBy("assignment_id", "cluster_id")
    least_first = F.struct(F.col("score"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
    found = scores.agg(F.avg("score").alias("average"), F.max("score").alias("highest"), F.max_by(F.struct("a", "b"), least_first).alias("best"))
    named = members.join(submissions.select("assignment_id", "submission_id", "student_id", "submitted_at"), ["assignment_id", "submission_id"], "left")
    student = F.coalesce("student_id", F.concat(F.lit("sub_"), F.substring(F.col("submission_id").cast("string"), -6, 6)))
    span = (F.unix_micros(F.max("submitted_at").cast("timestamp")) - F.unix_micros(F.min("submitted_at").cast("timestamp"))) / 60_000_000
    people = named.groupBy("assignment_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.array_sort(F.collect_list("submission_id")).alias("members"),
        F.array_sort(F.collect_set(student)).alias("students"),
        F.when(F.count("submitted_at") >= 2, F.round(span).cast("long")).alias("within_minutes"),
    )
    joined = people.join(found, ["assignment_id", "cluster_id"])
    return joined.select("assignment_id", "cluster_id", "size", F.round("average", 9).alias("average"), "highest", F.col("best.a").alias("best_a"), F.col("best.b").alias("best_b"), "members", "students", "within_minutes")


def ranked_clusters(stats: DataFrame) -> DataFrame:
    """cluster_stats() with place: the largest first within the assignment, then the one with the highest average; cluster_id decides ties."""
    return stats.withColumn("place", F.row_number().over(Window.partitionBy("assignment_id").orderBy(F.desc("size"), F.desc("average"), "cluster_id")))

"""Versions of submissions, and their deadlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STUDENT = ("assignment_id", "student_id")


def assign_version(attempts: DataFrame) -> DataFrame:
    """attempts with version: 1, 2, ... of a student's attempts by arrival."""
    return attempts.withColumn("version", F.row_number().over(Window.partitionBy(*STUDENT).orderBy("submitted_at", "submission_id")))


def latest_version(versioned: DataFrame) -> DataFrame:
    """Each student's fingerprinted row with the highest version; later, then larger submission_id first among equals."""
    newest = Window.partitionBy(*STUDENT).orderBy(F.desc("version"), F.desc("submitted_at"), F.desc("submission_id"))
    return versioned.where("status = 'fingerprinted'").withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def version_history(versioned: DataFrame) -> DataFrame:
    """versioned with newest (1 for the last attempt, counted back) and is_latest."""
    nth = F.row_number().over(Window.partitionBy(*STUDENT).orderBy(F.desc("version")))
    return versioned.withColumn("newest", nth).withColumn("is_latest", nth == 1)


def deadline_filter(submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """submissions of the assignments with accepted: sent before the deadline."""
    return submissions.join(assignments.select("assignment_id", "deadline"), "assignment_id").withColumn("accepted", F.col("submitted_at") < F.col("deadline"))


def deadline_history(changes: DataFrame) -> DataFrame:
    """Changes of deadlines (key, changed_at, deadline) with the deadline before; the first row of a key is no change."""
    before = F.lag("deadline").over(Window.partitionBy("key").orderBy("changed_at", "deadline"))
    return changes.select("key", "changed_at", before.alias("old_deadline"), F.col("deadline").alias("new_deadline")).where("old_deadline is not null and old_deadline <> new_deadline")


def deadline_versions(changes: DataFrame) -> DataFrame:
    """assignment_id, deadline, valid_from, valid_to of every change (assignment_id, changed_at, deadline): in force from its change up to the next one, without end if it is the last. Of changes at one time the latest deadline stays."""
    last = changes.groupBy("assignment_id", "changed_at").agg(F.max("deadline").alias("deadline"))
    following = F.lead("changed_at").over(Window.partitionBy("assignment_id").orderBy("changed_at"))
    return last.select("assignment_id", "deadline", F.col("changed_at").alias("valid_from"), following.alias("valid_to"))


def in_force(attempts: DataFrame, versions: DataFrame) -> DataFrame:
    """attempts (assignment_id, submitted_at, ...) with the deadline that was in force when they arrived, and accepted: sent before it.

    An equi-join on the assignment whose condition picks the one version that
    holds at the time, so no row comes twice; a hot assignment's attempts can
    be split, as only its few versions are on the other side. Attempts before
    the first version, or without a time, have no deadline and aren't accepted.
    """
    v = versions.select(F.col("assignment_id").alias("_assignment"), F.col("deadline"), "valid_from", "valid_to")
    holds = (attempts["assignment_id"] == F.col("_assignment")) & (attempts["submitted_at"] >= F.col("valid_from")) & (F.col("valid_to").isNull() | (attempts["submitted_at"] < F.col("valid_to")))
    joined = attempts.join(v, holds, "left")
    return joined.select(*(attempts[c] for c in attempts.columns), "deadline", F.coalesce(attempts["submitted_at"] < F.col("deadline"), F.lit(False)).alias("accepted"))


def enroll_new(enrolled: DataFrame, wanted: DataFrame) -> DataFrame:
    """The distinct (assignment_id, student_id) of wanted that aren't enrolled yet."""
    return wanted.select(*STUDENT).distinct().join(enrolled.select(*STUDENT), list(STUDENT), "left_anti")

"""Submissions stored by assignment, and scans of the assignments that are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import has_data

#: Rows of a file of the store; a larger assignment has several.
FILE_ROWS = 1_000_000


def store_submissions(submissions: DataFrame, path: str) -> None:
    """Write submissions into one folder for each assignment_id; the assignments that submissions has are replaced, others stay.

    Rows are dealt by assignment and a number beside it, as many as its rows
    need, so that a hot assignment is written by several tasks and others make
    one file each.
    """
    counts = submissions.groupBy("assignment_id").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_parts"))
    rows = submissions.join(counts, "assignment_id").withColumn("_part", F.floor(F.rand(7) * F.col("_parts")))
    dealt = rows.repartition("assignment_id", "_part").drop("_parts", "_part")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assignment_id").parquet(path)


def scan_wanted(spark: SparkSession, path: str, wanted: DataFrame, schema: str | None = None) -> DataFrame:
    """The stored submissions of the wanted assignments (assignment_id).

    A semi-join on the folder's column: Spark evaluates wanted first and reads
    those folders alone (dynamic partition pruning), if wanted comes of a
    filter and is small enough to be broadcast; else it is a join as any other.
    """
    if not has_data(spark, path):
        raise FileNotFoundError(f"nothing is stored in {path}")
    stored = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return stored.join(wanted.select("assignment_id"), "assignment_id", "left_semi")

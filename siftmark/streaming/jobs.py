"""Structured Streaming twins of the batch operators.

Each batch runs inside foreachBatch with the batch functions, writes under its
own number and reads nothing but what earlier numbers wrote, so a batch that
runs again, in this process or after a restart, replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructType

from ..operators.fingerprint import code_fingerprints
from ..operators.versions import STUDENT, in_force
from ..sources.durable import make_folder
from ..sources.durable import new_folder as work_folder  # noqa: F401  a stream's files are kept beside the checkpoints


class Progress(StreamingQueryListener):
    """Counts batches and rows of the streams that ran since it was added, by run id; failed holds the errors of those that ended with one."""

    def __init__(self):
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.batches[str(event.runId)] = self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        self.batches[run] = self.batches.get(run, 0) + 1
        self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.failed[str(event.runId)] = event.exception


def stream_table(spark: SparkSession, sf_dir: str, table: str, files_at_once: int = 1) -> DataFrame:
    """A table's files as a stream; the table may be a folder or a single file, so it is named by a pattern, which a stream takes for either."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[t]")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str) -> None:
    """Run each over everything there is, batch by batch. When a batch is done, its number of rows is written beside it: see read_progress()."""

    def counted(batch: DataFrame, number: int) -> None:
        seen = Observation()
        each(batch.observe(seen, F.count(F.lit(1)).alias("rows")), number)
        done = batch.sparkSession.createDataFrame([(seen.get["rows"],)], "rows long").withColumn("ended_at", F.current_timestamp())
        done.coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")

    query = stream.writeStream.foreachBatch(counted).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """batch, rows, ended_at of all batches that run_batches() has ended in this folder, in whatever process; one that ran again counts once."""
    return _written(spark, f"{folder}/progress", "rows long, ended_at timestamp, batch int").select("batch", "rows", "ended_at")


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Write a stream to Parquet in append mode, and read what it wrote."""
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return _written(stream.sparkSession, f"{folder}/out", schema)


def _written(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What batches have written below path; nothing if none has come yet."""
    make_folder(spark, path)
    return spark.read.schema(schema).parquet(path)


_PRINTS = "assignment_id string, submission_id long, hash long, pos int, start_line int, end_line int, batch int"


def stream_fingerprints(submissions: DataFrame, folder: str) -> DataFrame:
    """Fingerprints of arriving submissions (KEYS, code, language, file_name)."""

    def each(batch: DataFrame, number: int) -> None:
        code_fingerprints(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run_batches(submissions, each, folder)
    return _written(submissions.sparkSession, f"{folder}/out", _PRINTS).drop("batch")


def stream_candidates(submissions: DataFrame, folder: str) -> DataFrame:
    """levels.stream_candidates(): pairs of arriving submissions, over an index in merged levels."""
    from . import levels  # which needs this module

    return levels.stream_candidates(submissions, folder)


def stream_deadline(attempts: DataFrame, deadlines: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Arriving attempts before the deadline of their assignment (a static table), and those that came later, which go to a table of their own."""
    spark = attempts.sparkSession
    few = _small(deadlines)

    def each(batch: DataFrame, number: int) -> None:
        joined = batch.join(F.broadcast(deadlines) if few else deadlines, "assignment_id")
        late = (F.col("submitted_at") >= F.col("deadline")).cast("int").alias("late")
        joined.select("*", late).write.mode("overwrite").partitionBy("late").parquet(f"{folder}/out/batch={number}")

    run_batches(attempts, each, folder)
    # columns of no stream: a reader of the folder needs their types even before a row has come
    columns = attempts.sparkSession.createDataFrame([], attempts.schema).join(deadlines.limit(0), "assignment_id").schema.add("batch", IntegerType()).add("late", IntegerType())
    found = _written(spark, f"{folder}/out", columns).drop("batch")
    return found.where("late = 0").drop("late"), found.where("late = 1").drop("late")


def stream_deadline_versions(attempts: DataFrame, versions: Callable[[], DataFrame], folder: str) -> DataFrame:
    """in_force() of arriving attempts, all of them, late ones with accepted false.

    versions gives the table of deadline_versions() anew in each batch, so an
    extension counts for what arrives after it, and a batch that runs again
    judges by the attempts' own times, as before.
    """
    spark = attempts.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        table = versions()
        in_force(batch, F.broadcast(table) if _small(table) else table).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run_batches(attempts, each, folder)
    schema = in_force(spark.createDataFrame([], attempts.schema), versions()).schema.add("batch", IntegerType())
    return _written(spark, f"{folder}/out", schema).drop("batch")


def _small(table: DataFrame, most: int = 100_000) -> bool:
    """Whether a static table has few enough rows to be sent to every task."""
    return table.limit(most + 1).count() <= most


def stream_latest(attempts: DataFrame, folder: str) -> DataFrame:
    """assignment_id, student_id, submission_id, submitted_at, n: each student's last attempt, and how many there were.

    Each batch writes its own students' last attempts and counts, whatever
    came before; reading merges them, so there is no state to lose or to count
    twice.
    """
    spark = attempts.sparkSession
    schema = f"assignment_id string, student_id string, submission_id long, submitted_at {attempts.schema['submitted_at'].dataType.simpleString()}, n long"

    def merged(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("submission_id", "submitted_at"), F.struct("submitted_at", "submission_id")).alias("last")
        return rows.groupBy(*STUDENT).agg(last, F.sum("n").alias("n")).select(*STUDENT, "last.submission_id", "last.submitted_at", "n")

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(*STUDENT, "submission_id", "submitted_at", F.lit(1).cast("long").alias("n"))
        merged(rows).write.mode("overwrite").parquet(f"{folder}/last/batch={number}")

    run_batches(attempts, each, folder)
    return merged(_written(spark, f"{folder}/last", schema))


def burst_counts(attempts: DataFrame, minutes: int = 60) -> DataFrame:
    """assignment_id, window_start, n: attempts in windows of event time, of a stream with a watermark of one window or of a table."""
    late, kind = f"{minutes} minutes", attempts.schema["submitted_at"].dataType
    # a watermark needs a timestamp with a time zone; the windows get the type of the column again
    rows = attempts.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).withWatermark("submitted_at", late) if attempts.isStreaming else attempts
    counts = rows.groupBy("assignment_id", F.window("submitted_at", late).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("assignment_id", F.col("w.start").cast(kind).alias("window_start"), "n")


def stream_bursts(attempts: DataFrame, folder: str, minutes: int = 60) -> DataFrame:
    """burst_counts() of a stream, those windows that its watermark has closed."""
    return run_append(burst_counts(attempts, minutes), folder)

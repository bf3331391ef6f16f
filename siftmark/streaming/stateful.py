"""Streams that keep state in a state store: sessions, submissions delivered more than once, and each student's last attempt."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.versions import STUDENT
from ..sources.durable import has_data
from .jobs import run_append

_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A map-side merge, so that of a hot assignment only sessions are shuffled.
_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Sessions


def sessions(attempts: DataFrame, gap_minutes: int = 30, delay_minutes: int = 60) -> DataFrame:
    """assignment_id, session_start, session_end, n, students: bursts of attempts of an assignment, each less than gap_minutes after another.

    Of a table, or of a stream whose watermark is delay_minutes behind the
    latest attempt; then sessions that it has passed come out, and attempts
    that belong to them are too late. session_end is gap_minutes after the last
    attempt; students is the estimate of a mergeable sketch, so that state and
    shuffle hold no lists of students. Attempts without a time are in no session.
    """
    kind = attempts.schema["submitted_at"].dataType
    rows = attempts.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).where("submitted_at IS NOT NULL")
    if attempts.isStreaming:
        rows = rows.withWatermark("submitted_at", f"{delay_minutes} minutes")
    found = rows.groupBy("assignment_id", F.session_window("submitted_at", f"{gap_minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("student_id").alias("students"))
    return found.select("assignment_id", F.col("w.start").cast(kind).alias("session_start"), F.col("w.end").cast(kind).alias("session_end"), "n", "students")


def stream_sessions(attempts: DataFrame, folder: str, gap_minutes: int = 30, delay_minutes: int = 60) -> DataFrame:
    """sessions() of a stream, those that its watermark has closed; what is open stays in the state for the next run."""
    with settings(attempts.sparkSession, _SESSIONS):
        return run_append(sessions(attempts, gap_minutes, delay_minutes), folder)


# Submissions delivered more than once


def stream_once(submissions: DataFrame, folder: str, horizon: str = "1 day", keys: tuple[str, ...] = ("submission_id",)) -> DataFrame:
    """The first row of every submission of a source that may deliver one again, within horizon of event time (submitted_at).

    The keys that were seen are state, which ends when the watermark, horizon
    behind the latest row, has passed them; so a redelivery after that is late
    by at least as much, and is dropped as a late row. The folder's checkpoint
    carries the state over restarts.
    """
    kind = submissions.schema["submitted_at"].dataType
    rows = submissions.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).withWatermark("submitted_at", horizon)
    return run_append(rows.dropDuplicatesWithinWatermark(list(keys)), folder).withColumn("submitted_at", F.col("submitted_at").cast(kind))


# The last attempt of every student


class LatestAttempt(StatefulProcessor):
    """Keeps (micros, submission_id, n) of one student's attempts in one assignment, the time as microseconds; gives them out whenever they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", "micros long, submission_id long, n long")

    def handleInputRows(self, key, rows, timerValues):
        best, n = None, 0
        if self._latest.exists():
            at, submission, n = self._latest.get()
            best = None if at is None else (at, submission)
        for row in rows:
            n += 1
            if row.micros is not None and (best is None or (row.micros, row.submission_id) > best):
                best = row.micros, row.submission_id
        at, submission = best or (None, None)
        self._latest.update((at, submission, n))
        yield Row(assignment_id=key[0], student_id=key[1], submission_id=submission, micros=at, n=n)

    def close(self) -> None:
        pass


def run_latest(attempts: DataFrame, folder: str) -> None:
    """Bring the state in folder up to date with the attempts that have arrived (STUDENT, submission_id, submitted_at)."""
    spark = attempts.sparkSession
    rows = attempts.select(*STUDENT, "submission_id", F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("micros"))
    out = "assignment_id string, student_id string, submission_id long, micros long, n long"
    with settings(spark, _ROCKS):
        kept = rows.groupBy(*STUDENT).transformWithState(LatestAttempt(), out, "Update", "None")
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """assignment_id, student_id, submission_id, submitted_at, n as the state of run_latest() has them: one row a student, however many batches there were."""
    if not has_data(spark, f"{folder}/offsets/commits"):  # no batch has ended yet
        return spark.createDataFrame([], "assignment_id string, student_id string, submission_id long, submitted_at timestamp, n long")
    with settings(spark, _ROCKS):
        state = spark.read.format("statestore").option("path", f"{folder}/offsets").option("stateVarName", "latest").load()
    return state.select("key.assignment_id", "key.student_id", "value.submission_id", F.timestamp_micros("value.micros").alias("submitted_at"), "value.n")


def stream_latest_state(attempts: DataFrame, folder: str) -> DataFrame:
    """assignment_id, student_id, submission_id, submitted_at, n: each student's last attempt, and how many there were.

    The state store holds one value a student; each batch reads and writes the
    values of its own students alone, and the table is read from the store.
    The later attempt counts, and of two at one time the larger submission_id;
    attempts without a time count, but are never the last one.
    """
    kind = attempts.schema["submitted_at"].dataType
    run_latest(attempts, folder)
    return read_latest(attempts.sparkSession, folder).withColumn("submitted_at", F.col("submitted_at").cast(kind))

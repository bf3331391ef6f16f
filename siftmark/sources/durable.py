"""Intermediate tables that several steps read, in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir). Only a session whose driver and executors are one process may have none set: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints; drop_folder() removes it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """The folder's file system and its path there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder that isn't there yet."""
    store, place = _place(spark, path)
    store.mkdirs(place)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and holds anything but hidden files and markers; a success marker isn't needed."""
    store, place = _place(spark, path)
    return store.exists(place) and any(not f.getPath().getName().startswith(("_", ".")) for f in store.listStatus(place))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of new_folder(), in whatever store it is."""
    store, place = _place(spark, path)
    store.delete(place, True)


#: Tasks a core that write an intermediate: enough to even out, and few enough not to fill the store with small files.
PER_CORE = 4


def few_files(df: DataFrame, per_core: int = PER_CORE) -> DataFrame:
    """df in at most so many partitions a core of the session, by merging whole partitions without a shuffle; where rows are numbered by partition, they must be before."""
    return df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over as many tasks as a shuffle of the session has, and a task a core at least.

    Rows that are few bytes here and much work further on (texts before they
    fall into tokens) would else stay in the few tasks of their files, or go
    to a few when adaptive execution merges small partitions; it leaves a
    number that is given alone.
    """
    return df.repartition(session_tasks(df.sparkSession), *keys)


def session_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle of the session, and one a core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def kept(df: DataFrame, per_core: int = PER_CORE) -> DataFrame:
    """df, computed once and kept in the shared folder, so a lost executor takes nothing with it.

    A local store starts a process for each file it writes, and a cluster's
    store suffers from small files too, so there are few_files().
    """
    shared_folder(df.sparkSession)
    return few_files(df, per_core).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage between the rounds of a long job: Spark removes the shuffle files, broadcasts and checkpoints of frames that nobody holds any more only then."""
    spark.sparkContext._jvm.System.gc()

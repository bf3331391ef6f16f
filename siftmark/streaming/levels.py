"""An inverted index that a stream adds to, in runs that are merged by levels.

Batch n writes a run of level 0; whenever FAN runs of a level are full, they
become one of the next level. So the batches before n are in at most FAN - 1
runs a level, whatever restarts there were: they are the digits of n to the
base FAN. A run is split by bucket of the hash and sorted by hash inside, so a
batch reads the buckets and row groups that its own hashes may be in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import code_arrays
from ..operators.pairs import by_thousands, equal_sets
from ..sources.durable import drop_folder, kept, make_folder, spread
from .jobs import run_batches

FAN, BUCKETS = 4, 16
_INDEX = "assignment_id string, submission_id long, hash long, of int, level int, run int, bucket int"
#: Classes of equal sets of a batch, by their smallest submission_id x, and those of the same batch or an earlier one (of) that they meet; the classes' members, by thousands.
_PAIRS = "assignment_id string, x long, y long, of int, shared long, batch int"
_MEMBERS = "assignment_id string, rep long, ids array<long>, batch int"


def runs_before(number: int) -> list[tuple[int, int]]:
    """(level, run) of the runs that hold the batches before this one; a run of a level holds FAN ** level batches."""
    out, level = [], 0
    while number:
        number, digit = divmod(number, FAN)
        out += [(level, number * FAN + k) for k in range(digit)]
        level += 1
    return out


def merges_before(number: int) -> list[tuple[int, int]]:
    """The runs above level 0 that are full once this many batches are there, and weren't before the last one."""
    out, level = [], 1
    while number and number % FAN == 0:
        number //= FAN
        out.append((level, number - 1))
        level += 1
    return out


def _path(folder: str, level: int, run: int) -> str:
    return f"{folder}/index/level={level}/run={run}"


def read_runs(spark: SparkSession, folder: str, runs: list[tuple[int, int]]) -> DataFrame:
    paths = [_path(folder, *r) for r in runs]
    for p in paths:
        make_folder(spark, p)  # a run of batches without rows
    return spark.read.schema(_INDEX).option("basePath", f"{folder}/index").parquet(*paths) if paths else spark.createDataFrame([], _INDEX)


def write_run(rows: DataFrame, folder: str, level: int, run: int) -> None:
    """Rows (assignment_id, submission_id, hash, and of, the number of their batch) as a run, in place of what there was under its name: one file a bucket."""
    bucket = F.pmod("hash", F.lit(BUCKETS)).cast("int")
    dealt = rows.select("assignment_id", "submission_id", "hash", "of", bucket.alias("bucket")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "hash")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(_path(folder, level, run))


def add_batch(spark: SparkSession, folder: str, sets: DataFrame, number: int) -> DataFrame:
    """Add batch number to the index, and return the rows of all batches before it that may share a hash with it.

    Runs that a merge has replaced are removed one batch later: until then this
    batch may run again and merge them again.
    """
    for level, run in merges_before(number - 1) if number else []:
        for k in range(FAN):
            drop_folder(spark, _path(folder, level - 1, run * FAN + k))
    for level, run in merges_before(number):
        write_run(read_runs(spark, folder, [(level - 1, run * FAN + k) for k in range(FAN)]), folder, level, run)
    write_run(sets.withColumn("of", F.lit(number)), folder, 0, number)
    own = read_runs(spark, folder, [(0, number)])
    buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most BUCKETS
    return read_runs(spark, folder, runs_before(number)).where(F.col("bucket").isin(buckets))


def _expanded(spark: SparkSession, folder: str) -> DataFrame:
    """assignment_id, a, b, shared of the members of all classes that the batches found to meet. Thousands of members go to a task for each two classes, and only there they become pairs."""
    for name in ("pairs", "members"):
        make_folder(spark, f"{folder}/{name}")
    met, members = spark.read.schema(_PAIRS).parquet(f"{folder}/pairs"), spark.read.schema(_MEMBERS).parquet(f"{folder}/members")
    side = lambda rep, batch: members.select("assignment_id", F.col("rep").alias(rep), F.col("batch").alias(batch), F.col("ids").alias(f"ids_{rep}")).hint("merge")
    both = met.join(side("x", "batch"), ["assignment_id", "x", "batch"]).join(side("y", "of"), ["assignment_id", "y", "of"])
    inside = (F.col("x") == F.col("y")) & (F.col("batch") == F.col("of"))
    # of two thousands of one class either way round, that with the smaller ids first is enough
    dealt = both.where(~inside | (F.col("ids_x")[0] <= F.col("ids_y")[0])).withColumn("nth", F.xxhash64(F.col("ids_x")[0], F.col("ids_y")[0]))
    pairs = spread(dealt, "assignment_id", "x", "y", "nth").select("assignment_id", "shared", inside.alias("inside"), "ids_y", F.explode("ids_x").alias("p")).select("assignment_id", "shared", "inside", "p", F.explode("ids_y").alias("q"))
    return pairs.where("p < q OR NOT inside AND p > q").select("assignment_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared")


def stream_candidates(submissions: DataFrame, folder: str) -> DataFrame:
    """assignment_id, a, b, shared of arriving submissions (KEYS, code, language, file_name) against all that came before and with them; each pair once, when its later side arrives.

    What is written are classes of equal sets, their members, and the pairs of
    classes: pairs of submissions come of them when they are read, so the
    folder grows with the submissions and the different sets.
    """
    spark = submissions.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        # rows of a batch are counted on the way to its first shuffle; adaptive execution may drop what comes before one without rows
        arrays = kept(code_arrays(batch))
        classes = kept(equal_sets(arrays, ["assignment_id"]).withColumn("rep", F.col("all")[0]))
        classes.select("assignment_id", "rep", F.explode(by_thousands()).alias("ids")).write.mode("overwrite").parquet(f"{folder}/members/batch={number}")
        sets = classes.select("assignment_id", F.col("rep").alias("submission_id"), F.explode("hashes").alias("hash"))
        before = add_batch(spark, folder, sets, number)
        side = lambda rows, name, *of: rows.select("assignment_id", "hash", F.col("submission_id").alias(name), *of)
        # an index is far larger than its files, so it isn't gathered on the driver
        met = side(sets, "x").join(side(before, "y", "of").hint("merge"), ["assignment_id", "hash"])
        met = met.unionByName(side(sets, "x").join(side(sets, "y", F.lit(number).alias("of")).hint("merge"), ["assignment_id", "hash"]).where("x < y"))
        found = met.groupBy("assignment_id", "x", "y", "of").agg(F.count(F.lit(1)).alias("shared"))
        alike = classes.where("size(all) > 1").select("assignment_id", F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(number).alias("of"), F.size("hashes").cast("long").alias("shared"))
        found.unionByName(alike).write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")

    run_batches(submissions, each, folder)
    return _expanded(spark, folder)

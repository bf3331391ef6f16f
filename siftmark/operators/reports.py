"""Rankings, histograms, counts and dashboards over results and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evidence import HIGH, MEDIUM, risk_level

# Lower ends of the score buckets, and hours before a deadline that count as soon.
BUCKETS = {"0-20": 0.0, "20-40": 0.2, "40-60": 0.4, "60-80": 0.6, "80-100": 0.8}
SOON_HOURS = 48


def _micros(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def ranked(results: DataFrame) -> DataFrame:
    """results with place: by raw, then adjusted, both falling, within the assignment; ids decide ties."""
    order = Window.partitionBy("assignment_id").orderBy(F.desc("raw"), F.desc("adjusted"), "a", "b")
    return results.withColumn("place", F.row_number().over(order))


def competition_rank(results: DataFrame) -> DataFrame:
    """results with rank: 1, 2, 2, 4 on raw rounded to a tenth of a percent."""
    return results.withColumn("rank", F.rank().over(Window.partitionBy("assignment_id").orderBy(F.round(F.col("raw") * 1000).desc())))


def top_pairs(results: DataFrame, n: int = 5) -> DataFrame:
    return ranked(results).where(F.col("place") <= n)


def result_analytics(results: DataFrame) -> DataFrame:
    """assignment_id, pairs, average, high, medium."""
    return results.groupBy("assignment_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("raw"), 9).alias("average"), F.count_if(F.col("raw") >= HIGH).alias("high"), F.count_if((F.col("raw") >= MEDIUM) & (F.col("raw") < HIGH)).alias("medium")
    )


def score_histogram(results: DataFrame) -> DataFrame:
    """assignment_id, bucket, n with empty buckets; scores below 0 or null are in the first."""
    bucket = F.lit(next(iter(BUCKETS)))
    for name, low in list(BUCKETS.items())[1:]:
        bucket = F.when(F.col("raw") >= low, name).otherwise(bucket)
    names = F.array(*map(F.lit, BUCKETS))
    every = results.select("assignment_id").distinct().select("assignment_id", F.explode(names).alias("bucket"))
    counts = results.groupBy("assignment_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, ["assignment_id", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_risk(results: DataFrame, risk: str = "all", on: str = "raw") -> DataFrame:
    """results with risk; only those of the given one unless all."""
    rated = results.withColumn("risk", risk_level(F.col(on)))
    return rated if risk == "all" else rated.where(F.col("risk") == risk)


def distinct_students(submissions: DataFrame) -> DataFrame:
    """assignment_id, students, submissions."""
    return submissions.groupBy("assignment_id").agg(F.count_distinct("student_id").alias("students"), F.count(F.lit(1)).alias("submissions"))


#: Sketches have 2 ** LG_K registers: an error of some 0.65 percent, whatever they count, in 8 KB at most.
LG_K = 14


def student_sketches(submissions: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """assignment_id, day, students (a sketch), submissions: mergeable counts of distinct students by assignment and day of submitted_at, to be stored. Rows without a time are of no day (null)."""
    return submissions.groupBy("assignment_id", F.to_date("submitted_at").alias("day")).agg(F.hll_sketch_agg("student_id", lg_k).alias("students"), F.count(F.lit(1)).alias("submissions"))


def students_in_span(sketches: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """assignment_id, students (an estimate), submissions over the days from first to last (None: no end), of stored sketches; submissions themselves aren't read again."""
    days = sketches
    if first is not None:
        days = days.where(F.col("day") >= first)
    if last is not None:
        days = days.where(F.col("day") <= last)
    return days.groupBy("assignment_id").agg(F.hll_sketch_estimate(F.hll_union_agg("students")).alias("students"), F.sum("submissions").alias("submissions"))


def analysis_status(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """assignment_id, total, fingerprinted, failed, results."""
    counts = submissions.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "fingerprinted").alias("fingerprinted"), F.count_if(F.col("status") == "failed").alias("failed"))
    found = results.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("results"))
    return counts.join(found, "assignment_id", "left").withColumn("results", F.coalesce("results", F.lit(0)))


def owner_dashboard(assignments: DataFrame, submissions: DataFrame, results: DataFrame) -> DataFrame:
    """assignment_id, owner_id, created_at, students, results, display_status of every assignment."""
    students = submissions.groupBy("assignment_id").agg(F.count_distinct("student_id").alias("students"))
    found = results.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("results"))
    joined = assignments.join(students, "assignment_id", "left").join(found, "assignment_id", "left")
    n = F.coalesce("students", F.lit(0))
    status = (
        F.when(F.coalesce("results", F.lit(0)) > 0, "completed")
        .when(F.coalesce("analysis_status", F.lit("idle")).isin("idle", "completed"), F.when(n >= 2, "ready").otherwise("not_analyzed"))
        .otherwise(F.col("analysis_status"))
    )
    return joined.select("assignment_id", "owner_id", "created_at", n.alias("students"), F.coalesce("results", F.lit(0)).alias("results"), status.alias("display_status"))


def owner_summary(dashboard: DataFrame) -> DataFrame:
    """owner_id, assignments, students, completed, running."""
    return dashboard.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("assignments"), F.sum("students").alias("students"), F.count_if(F.col("display_status") == "completed").alias("completed"), F.count_if(F.col("display_status").isin("queued", "processing")).alias("running")
    )


def student_dashboard(enrolled: DataFrame, assignments: DataFrame, submissions: DataFrame, now: Column) -> DataFrame:
    """student_id, assignment_id, deadline, is_closed, submission_id, version, state, due_soon of every enrollment, with the student's last submission."""
    last = F.max_by(F.struct("submission_id", "version"), F.struct("version", "submission_id"))
    latest = submissions.groupBy("assignment_id", "student_id").agg(last.alias("last"))
    joined = enrolled.join(assignments.select("assignment_id", "deadline"), "assignment_id").join(latest, ["assignment_id", "student_id"], "left")
    hours = _micros(F.col("deadline"), now) / 3_600_000_000
    open_still = F.col("last").isNull()
    return joined.select(
        "student_id", "assignment_id", "deadline", (now >= F.col("deadline")).alias("is_closed"), F.col("last.submission_id").alias("submission_id"), F.col("last.version").alias("version"),
        F.when(open_still, "pending").otherwise("submitted").alias("state"), ((hours > 0) & (hours <= SOON_HOURS) & open_still).alias("due_soon"),
    )


def student_stats(dashboard: DataFrame) -> DataFrame:
    """student_id, total, submitted, pending (still open), due_soon."""
    return dashboard.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "submitted").alias("submitted"), F.count_if((F.col("state") == "pending") & ~F.col("is_closed")).alias("pending"), F.count_if("due_soon").alias("due_soon")
    )


def due_badge(deadline: Column, now: Column) -> Column:
    """Closed, or the time left in days, hours or minutes (1 at least)."""
    minutes = F.floor(_micros(deadline, now) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    left = F.when(days > 1, F.concat(days.cast("string"), F.lit(" days"))).when(days == 1, "1 day").when(hours >= 2, F.concat(hours.cast("string"), F.lit(" hours"))).when(hours >= 1, "1 hour")
    return F.when(now >= deadline, "Closed").otherwise(F.concat(F.lit("Due in "), left.otherwise(F.concat(F.greatest(F.lit(1), minutes).cast("string"), F.lit(" minutes")))))


def run_stats(submissions: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """assignment_id, found, possible_pairs, candidate_pairs, results_saved, reduction."""
    from .pairs import candidate_stats

    saved = results.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("results_saved"))
    return (
        candidate_stats(submissions, candidates)
        .join(saved, "assignment_id", "left")
        .select("assignment_id", F.col("n").alias("found"), F.col("naive_pairs").alias("possible_pairs"), F.col("candidates").alias("candidate_pairs"), F.coalesce("results_saved", F.lit(0)).alias("results_saved"), "reduction")
    )

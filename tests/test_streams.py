"""Streams over several runs: state that goes on, deliveries that come again, indexes that stay few, and folders without files."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftmark.operators import pairs, tokens, versions
from siftmark.operators.fingerprint import fingerprints
from siftmark.streaming import jobs, levels, stateful

ATTEMPTS = "assignment_id string, student_id string, submission_id long, submitted_at timestamp_ntz"
SOURCES = "assignment_id string, submission_id long, code string, language string, file_name string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


class Source:
    """A folder that files come into, read as a stream one file a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        Path(folder).mkdir(parents=True, exist_ok=True)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def test_redelivered_rows_come_once_also_after_a_restart(spark, tmp_path):
    source, out = Source(spark, f"{tmp_path}/in", ATTEMPTS), f"{tmp_path}/out"
    first = [("a", "s", k, at(k)) for k in range(20)]
    source.add([*first, *first[:5]])
    assert stateful.stream_once(source.stream(), out, "1 day").count() == 20
    source.add([*first[10:], ("a", "s", 100, at(30))])
    source.add([("a", "s", 100, at(31))])
    got = stateful.stream_once(source.stream(), out, "1 day")
    assert sorted(r.submission_id for r in got.collect()) == [*range(20), 100]
    source.add([("a", "s", 200, at(3 * 1440))])
    source.add([("a", "s", 5, at(6)), ("a", "s", 201, at(3 * 1440 + 1))])  # later than the horizon: the state has gone, the row is late
    got = stateful.stream_once(source.stream(), out, "1 day")
    assert sorted(r.submission_id for r in got.collect()) == [*range(20), 100, 200, 201]


def test_latest_attempts_live_in_the_store(spark, tmp_path):
    source, out = Source(spark, f"{tmp_path}/in", ATTEMPTS), f"{tmp_path}/out"
    rows = [("a", f"s{k % 7}", k, at((k * 37) % 101)) for k in range(60)] + [("a", "none", 900, None), ("a", "s1", 901, at(100)), ("a", "s1", 902, at(100))]
    for k in range(0, len(rows), 9):
        source.add(rows[k : k + 9])
        if k % 18 == 0:
            stateful.run_latest(source.stream(), out)
    got = {(r.student_id, r.submission_id, r.submitted_at, r.n) for r in stateful.stream_latest_state(source.stream(), out).collect()}
    want = set()
    for student in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == student]
        last = max(((r[3], r[2]) for r in own if r[3]), default=(None, None))
        want.add((student, last[1], last[0], len(own)))
    assert got == want
    assert stateful.read_latest(spark, out).count() == 8  # one row a student, after seven batches


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    source, out = Source(spark, f"{tmp_path}/in", ATTEMPTS), f"{tmp_path}/out"
    rows = [("a", "s", k, at(m)) for k, m in enumerate([0, 20, 45, 90, 119, 400])] + [("b", "s", 50, at(10)), ("b", "t", 51, None)]
    source.add(rows)
    closed = {(r.assignment_id, r.session_start, r.session_end, r.n) for r in stateful.stream_sessions(source.stream(), out).drop("students").collect()}
    assert closed == {("a", at(0), at(75), 3), ("a", at(90), at(149), 2), ("b", at(10), at(40), 1)}
    source.add([("a", "s", 60, at(410)), ("a", "s", 61, at(10)), ("a", "s", 62, at(900))])  # 61 is too late for its session
    closed = {(r.session_start, r.n) for r in stateful.stream_sessions(source.stream(), out).collect()}
    assert closed == {(at(0), 3), (at(90), 2), (at(10), 1), (at(400), 2)}
    table = stateful.sessions(spark.createDataFrame(rows, ATTEMPTS)).where("assignment_id = 'a'")
    assert sorted((r.session_start, r.n, r.students) for r in table.collect()) == [(at(0), 3, 1), (at(90), 2, 1), (at(400), 1, 1)]


def test_the_deadline_in_force_decides(spark, tmp_path):
    changes = [("a", at(0), at(60)), ("a", at(70), at(120)), ("a", at(130), at(125)), ("b", at(0), at(5)), ("b", at(0), at(9))]
    table = versions.deadline_versions(spark.createDataFrame(changes, "assignment_id string, changed_at timestamp_ntz, deadline timestamp_ntz"))
    sent = {1: 59, 2: 60, 3: 65, 4: 70, 5: 119, 6: 121, 7: 131}
    rows = [("a", "s", k, at(m)) for k, m in sent.items()] + [("a", "s", 8, at(-1)), ("b", "s", 9, at(8)), ("c", "s", 10, at(1)), ("a", "s", 11, None), ("b", "s", 9, at(8))]
    got = versions.in_force(spark.createDataFrame(rows, ATTEMPTS), table)
    assert {r.submission_id: (r.deadline, r.accepted) for r in got.collect()} == {
        1: (at(60), True), 2: (at(60), False), 3: (at(60), False), 4: (at(120), True), 5: (at(120), True), 6: (at(120), False), 7: (at(125), False),
        8: (None, False), 9: (at(9), True), 10: (None, False), 11: (None, False),
    }
    assert got.count() == len(rows)
    source = Source(spark, f"{tmp_path}/in", ATTEMPTS)
    source.add(rows)
    streamed = jobs.stream_deadline_versions(source.stream(), lambda: table, f"{tmp_path}/out")
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def test_an_extension_between_batches_counts(spark, tmp_path):
    source, out = Source(spark, f"{tmp_path}/in", ATTEMPTS), f"{tmp_path}/out"
    changes = [("a", at(0), at(60))]
    table = lambda: versions.deadline_versions(spark.createDataFrame(changes, "assignment_id string, changed_at timestamp_ntz, deadline timestamp_ntz"))
    source.add([("a", "s", 1, at(65))])
    jobs.stream_deadline_versions(source.stream(), table, out)
    changes.append(("a", at(66), at(90)))
    source.add([("a", "s", 2, at(67))])
    assert {r.submission_id: r.accepted for r in jobs.stream_deadline_versions(source.stream(), table, out).collect()} == {1: False, 2: True}


@pytest.mark.parametrize("number", [0, 1, 4, 5, 16, 27, 64, 1000, 4095, 123456])
def test_runs_are_few_and_hold_all_batches(number):
    held = sorted(b for level, run in levels.runs_before(number) for b in range(run * levels.FAN**level, (run + 1) * levels.FAN**level)) if number < 5000 else list(range(number))
    assert held == list(range(number))
    assert len(levels.runs_before(number)) <= 3 * len(f"{number:b}") // 2 + 3


def test_files_read_by_a_batch_are_bounded(spark, tmp_path):
    sets = lambda n: spark.createDataFrame([("a", 10 * n + k, (k * 7919 + n) % 1000) for k in range(10)], "assignment_id string, submission_id long, hash long")
    folder, files = str(tmp_path), []
    for n in range(18):
        before = levels.add_batch(spark, folder, sets(n), n)
        files.append(len(before.inputFiles()))
        levels.add_batch(spark, folder, sets(n), n)  # a batch that runs again changes nothing
        assert sorted(r.submission_id for r in levels.read_runs(spark, folder, levels.runs_before(n)).collect()) == list(range(10 * n))
        # each bucket of a run is one file; before n, there are at most FAN - 1 runs a level
        assert files[-1] <= levels.BUCKETS * len(levels.runs_before(n))
    assert files[16] <= levels.BUCKETS and files[17] <= 2 * levels.BUCKETS
    left = [p for p in Path(folder, "index").glob("level=*/run=*") if list(p.rglob("*.parquet"))]
    assert len(left) <= 3 + 2 * levels.FAN


def test_candidates_over_batches_are_those_of_a_table(spark, tmp_path):
    source = Source(spark, f"{tmp_path}/in", SOURCES)
    rows = [("a" if k % 2 else "b", k, f"def f(x):\n  total = {k % 3}\n  for i in range(x):\n    total = total + i * {k % 2} - x\n  return total" + "\n  y = 1" * (k % 4), "python", "f.py") for k in range(12)]
    for k in range(0, 12, 2):
        source.add(rows[k : k + 2])
    got = levels.stream_candidates(source.stream(), f"{tmp_path}/out")
    want = pairs.candidate_pairs(pairs.distinct_hashes(fingerprints(tokens.tokenize_any(spark.createDataFrame(rows, SOURCES)))))
    rows_of = lambda df: sorted(map(tuple, df.select("assignment_id", "a", "b", "shared").collect()))
    assert rows_of(got) == rows_of(want) and got.count() == 30


def test_folders_without_files(spark, tmp_path):
    code, sent = Source(spark, f"{tmp_path}/code", SOURCES), Source(spark, f"{tmp_path}/sent", ATTEMPTS)
    deadlines = spark.createDataFrame([("a", at(1))], "assignment_id string, deadline timestamp_ntz")
    assert jobs.stream_fingerprints(code.stream(), f"{tmp_path}/1").count() == 0
    assert levels.stream_candidates(code.stream(), f"{tmp_path}/2").count() == 0
    assert [x.count() for x in jobs.stream_deadline(sent.stream(), deadlines, f"{tmp_path}/3")] == [0, 0]
    assert jobs.stream_latest(sent.stream(), f"{tmp_path}/4").count() == 0
    assert jobs.stream_bursts(sent.stream(), f"{tmp_path}/5").count() == 0
    assert stateful.stream_sessions(sent.stream(), f"{tmp_path}/6").count() == 0
    assert stateful.stream_once(sent.stream(), f"{tmp_path}/7").count() == 0
    assert stateful.stream_latest_state(sent.stream(), f"{tmp_path}/8").count() == 0


def test_progress_outlives_a_run(spark, tmp_path):
    source, out = Source(spark, f"{tmp_path}/in", ATTEMPTS), f"{tmp_path}/out"
    for n in (3, 1):
        source.add([("a", "s", k, at(k)) for k in range(n)])
    jobs.stream_latest(source.stream(), out)
    source.add([("a", "s", 9, at(9))] * 5)
    jobs.stream_latest(source.stream(), out)
    assert sorted((r.batch, r.rows) for r in jobs.read_progress(spark, out).collect()) in ([(0, 3), (1, 1), (2, 5)], [(0, 1), (1, 3), (2, 5)])
    assert jobs.read_progress(spark, f"{tmp_path}/none").count() == 0

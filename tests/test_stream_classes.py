"""A stream of candidates writes classes of equal sets and their members, and no pairs of submissions."""

from siftmark.operators import fingerprint, pairs
from siftmark.streaming import levels

CODE = "assignment_id string, submission_id long, code string, language string, file_name string"


def program(k):
    return (f"a{k % 2}", k, "def f(x):\n    return x\n" + "    y = [x, x + 1]\n" * (k % 3) + "for i in f(2): print(i)\n" * 3, "python", None)


def test_folder_grows_with_submissions_and_not_with_their_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "_UNIT", 4)
    rows = [program(k) for k in range(90)]
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], CODE).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    # one that arrives again, with other code
    spark.createDataFrame([(*program(4)[:2], program(7)[2], "python", None)], CODE).write.parquet(str(tmp_path / "in" / "p3"))
    stream = spark.readStream.schema(CODE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = levels.stream_candidates(stream, str(tmp_path / "out"))
    columns = ["assignment_id", "a", "b", "shared"]
    found = sorted(map(tuple, got.select(columns).collect()))
    want = sorted(map(tuple, pairs.candidate_pairs(fingerprint.code_arrays(spark.createDataFrame(rows, CODE))).select(columns).collect()))
    again = [r for r in found if 4 in r[1:3]]
    assert len(want) == 90 * 44 // 2 and [r for r in found if 4 not in r[1:3]] == [r for r in want if 4 not in r[1:3]]
    assert len(again) == 2 * 44 and all(r[1] != r[2] for r in again)
    written = sum(spark.read.parquet(str(tmp_path / "out" / name)).count() for name in ("pairs", "members"))
    assert written < 200 < len(found)
    ids = spark.read.parquet(str(tmp_path / "out" / "members")).selectExpr("max(size(ids))", "sum(size(ids))").first()
    assert tuple(ids) == (4, 91)


def test_arrays_of_code_are_its_sets(spark):
    code = spark.createDataFrame([program(k) for k in range(9)] + [("b", 20, None, "java", None), ("b", 21, "x", "python", None)], CODE)
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(fingerprint.code_arrays(code).selectExpr("assignment_id", "submission_id", "explode(hashes) hash")) == rows(fingerprint.code_sets(code))

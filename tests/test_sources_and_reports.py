"""Layouts, archives by ranges, sketches, scorers, coverage, long diffs and reports: literal cases and brute force."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmark.operators import boilerplate, diff, evidence, intake, long_diff, reports
from siftmark.sources import archives, layout

CODE = "assignment_id string, submission_id long, code string, language string, file_name string"


# archives


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    files = {f"d{k % 7}/f{k}.py": bytes(rng.choices(range(32, 127), k=rng.randint(0, 400))) for k in range(10_000)}
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content, zipfile.ZIP_STORED if name.endswith("3.py") else zipfile.ZIP_DEFLATED)
    df = archives.read_archives(spark, [str(tmp_path / "large.zip")])
    assert df.rdd.getNumPartitions() >= 8
    got = {r.entry: (bytes(r.content), r.error) for r in df.collect()}
    assert got == {k: (v, None) for k, v in files.items()}


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("good.py", "flipped.py", "empty.py", "é.py"):
            z.writestr(name, "" if name == "empty.py" else f"{name} = 1\n" * 50)
        z.writestr("bomb.py", b"0" * 300_000)
        z.mkdir("folder")
    raw = bytearray(data.getvalue())
    at = raw.index(b"flipped.py") + len("flipped.py") + 4
    raw[at] ^= 0xFF
    (tmp_path / "some.zip").write_bytes(raw)
    (tmp_path / "cut.zip").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "none.zip").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("some.zip", "cut.zip", "none.zip", "missing.zip")]
    rows = {r.path.rsplit("/", 1)[-1]: r for r in archives.read_archives(spark, paths, maxEntry=100_000).collect()}
    assert set(rows) == {f"some.zip!{n}" for n in ("good.py", "flipped.py", "empty.py", "é.py", "bomb.py")} | {"cut.zip", "none.zip", "missing.zip"}
    assert rows["some.zip!good.py"].content == b"good.py = 1\n" * 50 and rows["some.zip!empty.py"].content == b""
    assert all(rows[n].error and rows[n].content is None for n in ("some.zip!flipped.py", "some.zip!bomb.py", "cut.zip", "none.zip", "missing.zip"))


def test_small_archives_share_a_task(spark, tmp_path):
    for k in range(60):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("a.py", f"x = {k}")
    df = archives.read_archives(spark, [str(tmp_path / f"{k}.zip") for k in range(60)], taskEntries=25)
    assert df.rdd.getNumPartitions() == 3 and df.select("content").distinct().count() == 60


def test_files_are_written_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", b"\x00\xff"), ("b.bin", b"")], "name string, content binary")
    assert archives.write_files(rows, f"{tmp_path}/out") == [f"{tmp_path}/out/a.bin", f"{tmp_path}/out/b.bin"]
    assert (tmp_path / "out/a.bin").read_bytes() == b"\x00\xff" and (tmp_path / "out/b.bin").read_bytes() == b""


# layout


def test_only_wanted_assignments_are_read(spark, tmp_path):
    rows = [(f"a{k % 40}", k, "x", "python", "f.py") for k in range(400)] + [(None, 999, "x", "python", "f.py")]
    layout.store_submissions(spark.createDataFrame(rows, CODE), f"{tmp_path}/s")
    spark.createDataFrame([(f"a{k}", k) for k in range(40)], "assignment_id string, owner long").write.parquet(f"{tmp_path}/owners")
    wanted = spark.read.parquet(f"{tmp_path}/owners").where("owner in (3, 7)")
    found = layout.scan_wanted(spark, f"{tmp_path}/s", wanted)
    assert sorted(r.submission_id for r in found.collect()) == sorted(k for k in range(400) if k % 40 in (3, 7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    nodes = found._jdf.queryExecution().executedPlan().collectLeaves()
    assert any("assignment_id" in nodes.apply(i).toString() for i in range(nodes.size()))


def test_stored_assignments_are_replaced_and_others_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "FILE_ROWS", 50)
    frame = lambda rows: spark.createDataFrame([(a, k, "x", "python", "f.py") for a, k in rows], CODE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be merged again
    layout.store_submissions(frame([("hot", k) for k in range(400)] + [("b", 1000)]), f"{tmp_path}/s")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "s/assignment_id=hot").glob("*.parquet"))) > 1
    layout.store_submissions(frame([("b", 1001), ("c", 1002)]), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 402
    with pytest.raises(FileNotFoundError):
        layout.scan_wanted(spark, f"{tmp_path}/nothing", frame([("b", 1)]))


# sketches


def test_sketches_are_close_and_merge(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("assignment_id"), F.concat(F.lit("s"), F.col("id") % 60_000).alias("student_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 10 as int))").alias("submitted_at"))
    rows = rows.unionByName(spark.createDataFrame([("a", None, None), ("b", "x", None)], rows.schema))
    sketches = reports.student_sketches(rows)
    assert sketches.count() == 12
    whole = {r.assignment_id: r for r in reports.students_in_span(sketches).collect()}
    assert abs(whole["a"].students - 60_000) < 0.02 * 60_000 and whole["a"].submissions == 200_001 and whole["b"].students == 1
    some = reports.students_in_span(sketches, F.lit("2024-01-02").cast("date"), F.lit("2024-01-04").cast("date")).first()
    exact = rows.where("to_date(submitted_at) between '2024-01-02' and '2024-01-04'").select("student_id").distinct().count()
    assert abs(some.students - exact) < 0.02 * exact and some.submissions == 60_000


# scorers


def test_a_scorer_gets_small_batches_in_order(spark):
    pairs = spark.range(500).select("id", F.concat(F.lit("p"), "id").alias("prompt_a"), F.lit("q").alias("prompt_b")).repartition(2)

    def scorer(batches):
        for batch in batches:
            assert len(batch) <= 16
            yield batch["prompt_a"].str[1:].astype(float) / 1000

    assert all(r.semantic_score == r.id / 1000 for r in intake.score_pairs(pairs, scorer, batch_rows=16).collect())
    assert intake.score_pairs(pairs).where("semantic_score is null").count() == 500
    assert intake.score_pairs(pairs.limit(0), scorer).count() == 0

    def short(batches):
        for batch in batches:
            yield batch["prompt_a"].str.len()[1:]

    with pytest.raises(Exception, match="scores for"):
        intake.score_pairs(pairs, short).collect()


def test_json_details(spark):
    texts = ['{"k": 5}', '{"k": "7"}', '{"k": "x"}', '{"k": {"j": [1, null]}}', "{", "", None, "3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, props string")
    found = intake.event_details(F.col("props"), {"k": ("$.k", "int"), "one": ("$.k.j[0]", "long")})
    got = [(r.k, r.one) for r in rows.select("i", *(c.alias(n) for n, c in found.items())).orderBy("i").collect()]
    assert got == [(5, None), (7, None), (None, None), (None, 1), (None, None), (None, None), (None, None), (None, None)]


# coverage


def test_coverage_is_that_of_sets_of_lines(spark, monkeypatch):
    monkeypatch.setattr(evidence, "COVER_BLOCK", 16)
    rng = random.Random(2)
    rows = [(key, first, first + rng.choice([-1, 0, 1, 5, 40, 90])) for key in range(60) for first in (rng.randint(1, 300) for _ in range(rng.randint(1, 12)))]
    want = {}
    for key, first, last in rows:
        want.setdefault(key, set()).update(range(first, last + 1))
    frame = spark.createDataFrame([*rows, (None, 3, 9), (None, 4, 10), (7, None, 4)], "key long, first long, last long")
    got = {r.key: r.lines for r in evidence.covered_lines(frame, ["key"]).collect()}
    assert got == {k: len(v) for k, v in want.items() if v} | {None: 8}
    regions = frame.where("key is not null and first is not null and first <= last").groupBy("key").agg(F.collect_list(F.struct(F.col("first").alias("sa"), F.col("last").alias("ea"))).alias("regions"))
    assert {r.key: r.n for r in regions.select("key", evidence.line_coverage(F.col("regions"), "a").alias("n")).collect()} == {k: len(v) for k, v in want.items() if v}


def test_regions_of_millions_of_lines_cost_nothing(spark):
    rows = spark.range(200).select(F.lit("x").alias("key"), (F.col("id") * 1_000_000).alias("first"), (F.col("id") * 1_000_000 + 1_500_000).alias("last"))
    assert evidence.covered_lines(rows, ["key"]).first().lines == 199 * 1_000_000 + 1_500_001
    regions = rows.agg(F.collect_list(F.struct(F.col("first").alias("sa"), F.col("last").alias("ea"))).alias("regions"))
    assert regions.select(evidence.line_coverage(F.col("regions"), "a")).first()[0] == 199 * 1_000_000 + 1_500_001


# long diffs


def script_of(spark, texts, pairs, rounds=3):
    lines = long_diff.numbered_lines(spark.createDataFrame([("p", k, t) for k, t in texts.items()], "assignment_id string, submission_id long, text string"))
    return long_diff.long_diff(spark.createDataFrame([("p", a, b) for a, b in pairs], "assignment_id string, a long, b long"), lines, rounds)


def rebuilt(rows, left, right):
    """The right text made of the left one by blocks; they must use both in order."""
    out, i, j = [], 0, 0
    for r in rows:
        a, b = (r.a_start, r.a_end) if r.a_start else (i + 1, i), (r.b_start, r.b_end) if r.b_start else (j + 1, j)
        assert a[0] == i + 1 and b[0] == j + 1, (a, b, i, j)
        assert {"equal": a[1] >= a[0] and b[1] - b[0] == a[1] - a[0], "delete": r.b_start is None, "insert": r.a_start is None, "modify": a[1] >= a[0] and b[1] >= b[0]}[r.type]
        out += left[a[0] - 1 : a[1]] if r.type == "equal" else right[b[0] - 1 : b[1]]
        i, j = a[1], b[1]
    assert i == len(left) and j == len(right)
    return out


def test_long_diffs_are_valid_scripts(spark):
    rng = random.Random(5)
    texts, pairs, k = {}, [], 0
    for n in range(60):
        words = [f"w{i}" for i in range(rng.choice([2, 5, 40, 400]))]
        left = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        right = [x for x in left if rng.random() < 0.8]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(right))
            right[at:at] = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        if n % 5 == 0:
            right = right[len(right) // 2 :] + right[: len(right) // 2]
        texts |= {2 * n: "\n".join(left), 2 * n + 1: "\n".join(right)}
        pairs.append((2 * n, 2 * n + 1))
    rows = {}
    for r in script_of(spark, texts, pairs).orderBy("a", "op_no").collect():
        rows.setdefault((r.a, r.b), []).append(r)
    longer = 0
    for a, b in pairs:
        left, right = texts[a].split("\n"), texts[b].split("\n")
        assert rebuilt(rows[a, b], left, right) == right
        assert all(x.type != y.type for x, y in zip(rows[a, b], rows[a, b][1:], strict=False))
        assert [r.op_no for r in rows[a, b]] == list(range(len(rows[a, b])))
        equal = sum(r.a_end - r.a_start + 1 for r in rows[a, b] if r.type == "equal")
        longer += len(diff.common_places(left, right)) - equal
    assert longer <= 0.05 * sum(len(t.split("\n")) for t in texts.values())


def test_a_long_pair_is_dealt_over_tasks(spark):
    rng = random.Random(6)
    left = [f"line {rng.randint(0, 10**9)}" if rng.random() < 0.5 else rng.choice(["}", "{", "end"]) for _ in range(200_000)]
    right = [x for x in left if rng.random() < 0.97]
    for _ in range(2000):
        right.insert(rng.randint(0, len(right)), f"new {rng.randint(0, 10**9)}")
    rows = script_of(spark, {1: "\n".join(left), 2: "\n".join(right)}, [(1, 2)]).orderBy("op_no").collect()
    assert rebuilt(rows, left, right) == right
    equal = sum(r.a_end - r.a_start + 1 for r in rows if r.type == "equal")
    assert equal >= 0.99 * (len(right) - 2000)  # of the lines that were kept


def test_texts_alike_empty_and_null(spark):
    got = [(r.a, r.type, r.a_start, r.a_end, r.b_start, r.b_end) for r in script_of(spark, {1: "a\nb", 2: " a\nb ", 3: None, 4: ""}, [(1, 2), (3, 4), (1, 3)]).orderBy("a", "b", "op_no").collect()]
    assert got == [(1, "equal", 1, 2, 1, 2), (1, "modify", 1, 2, 1, 1), (3, "equal", 1, 1, 1, 1)]


# reports


def test_the_report_on_two_texts(spark):
    one = "def f(items):\n  total = 0\n  for x in items:\n    total = total + x * 2\n  return total\n"
    rows = [("d", 1, one, "python", "a.py"), ("d", 2, re.sub("total", "acc", one), "python", "b.py"), ("d", 3, "x", "python", "c.py")]
    r = evidence.text_report(spark.createDataFrame(rows, CODE)).collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].raw, r[0].risk, r[0].renamed) == (1, 2, 1.0, "high", True)
    assert r[0].n_tokens_a == r[0].n_tokens_b > 20 and r[0].n_fingerprints_a == r[0].shared and r[0].regions[0].sa == 1
    assert r[0].explanation[0] == "Nearly all of the remaining code agrees (100.0%)."


def test_boilerplate_splits_the_sets(spark):
    sets = spark.createDataFrame([("a", k, h) for k in range(4) for h in (1, 10 + k)], "assignment_id string, submission_id long, hash long")
    stats = boilerplate.boilerplate_stats(boilerplate.hash_frequency(sets, sets.select("assignment_id", "submission_id").distinct()))
    assert {r.hash for r in boilerplate.only_boilerplate(sets, stats).collect()} == {1}
    assert {r.hash for r in boilerplate.without_boilerplate(sets, stats).collect()} == {10, 11, 12, 13}

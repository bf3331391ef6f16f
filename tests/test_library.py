"""Literal cases of the domain, and properties that SQL can't state."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from siftmark.functions.hashing import token_value
from siftmark.operators import boilerplate, clusters, diff, evidence, fingerprint, intake, language, pairs, reports, tokens, versions
from siftmark.sources import ingest
from siftmark.streaming import jobs as st

CODE = "assignment_id string, submission_id long, code string, language string, file_name string"


def types(spark, code, lang):
    df = spark.createDataFrame([("a", 1, code)], "assignment_id string, submission_id long, code string")
    return " ".join(r.type for r in tokens.tokenize(df, lang).orderBy("pos").collect())


@pytest.mark.parametrize(
    ("lang", "code", "expected"),
    [
        ("python", "total = x + y", "VAR = VAR + VAR"),
        ("python", 'name = "hello"', "VAR = STR"),
        ("python", "x = 5 # note", "VAR = NUM"),
        ("python", "if x > 0:\n  return y", "IF VAR > NUM : RETURN VAR"),
        ("python", "a //= .5 ** b'''x\ny'''", "VAR FLOOR_DIV = . NUM ** VAR STR"),
        ("javascript", "const result = getValue(input);", "CONST VAR = VAR ( VAR ) ;"),
        ("javascript", "a?.b ?? `t\n${x}` === 0x1F /* c */ + 10n // d", "VAR OPTIONAL_CHAIN VAR NULLISH_COALESCE STR === NUM + NUM"),
        ("javascript", "constructor = 1", "VAR = NUM"),
        ("java", "public class Solution { int count = 0; }", "PUBLIC CLASS VAR { TYPE VAR = NUM ; }"),
        ("java", "@Override x -> 1e5", "VAR => NUM VAR"),
        ("c", "struct Point { int x; int y; };", "STRUCT VAR { TYPE VAR ; TYPE VAR ; } ;"),
        ("cpp", '#include <iostream>\ncout << 5 << "s";', "INCLUDE VAR STREAM_OUT NUM STREAM_OUT STR ;"),
        ("csharp", "using System; class Program { static void Main() { } }", "USING VAR ; CLASS VAR { STATIC VOID VAR ( ) { } }"),
        ("csharp", 'var s = @"a\nb" + $"c";', "VAR_KW VAR = STR + STR ;"),
        ("c", "/* open", ""),
        ("c", "   ", ""),
    ],
)
def test_tokens(spark, lang, code, expected):
    assert types(spark, code, lang) == expected


def test_long_literals_do_not_break_the_lexer(spark):
    assert types(spark, 'x = "' + '\\"' * 100_000 + '"', "javascript") == "VAR = STR"
    assert types(spark, "/*" + "*a" * 100_000 + "*/ x", "java") == "VAR"


def test_places(spark):
    df = spark.createDataFrame([("a", 1, "x = '''a\nb''' + y\n  z")], "assignment_id string, submission_id long, code string")
    got = [(r.original, r.line, r.column) for r in tokens.tokenize(df, "python").orderBy("pos").collect()]
    assert got == [("x", 1, 0), ("=", 1, 2), ("TRIPLE_STRING", 1, 4), ("+", 2, 5), ("y", 2, 7), ("z", 3, 2)]


def test_token_values(spark):
    rows = spark.createDataFrame([(x,) for x in ("VAR", "NUM", "STR", "IF", "=", "+=")], "t string").select("t", token_value(F.col("t")).alias("v")).collect()
    assert dict(map(tuple, rows)) == {"VAR": 84743, "NUM": 77670, "STR": 82449, "IF": 2333, "=": 61, "+=": 1394}


def hashes_frame(spark, values):
    return spark.createDataFrame([("a", 1, h, i, 1, 1) for i, h in enumerate(values)], "assignment_id string, submission_id long, hash long, pos int, start_line int, end_line int")


def winnowed(values, w):
    out, last = [], -1
    for i in range(max(1, len(values) - w + 1)):
        window = range(i, min(i + w, len(values)))
        at = max(window, key=lambda j: (-values[j], j))
        if at != last:
            out.append((values[at], at))
            last = at
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_winnow(spark, seed):
    rng = random.Random(seed)
    for values in ([77, 74, 42, 17, 98, 21, 83], [5, 5], [3], [rng.randint(0, 9) for _ in range(40)]):
        got = sorted((r.hash, r.pos) for r in fingerprint.winnow(hashes_frame(spark, values)).collect())
        assert got == winnowed(values, 4)


def test_bad_parameters(spark):
    frame = hashes_frame(spark, [1])
    for call in (lambda: fingerprint.winnow(frame, 0), lambda: fingerprint.kgrams(frame, 0), lambda: fingerprint.kgram_hashes(frame, -1)):
        with pytest.raises(ValueError, match="positive"):
            call()


def test_renaming_keeps_fingerprints(spark):
    one = "def total(items):\n    s = 0\n    for x in items:\n        s += x\n    return s\n"
    two = one.replace("total", "sum_up").replace("items", "rows").replace("x", "row_").replace("s ", "acc ")
    df = spark.createDataFrame([("a", 1, one, "py", None), ("a", 2, two, "auto", "w.py")], CODE)
    got = fingerprint.fingerprints(tokens.tokenize_any(df)).collect()
    assert {(r.hash, r.pos) for r in got if r.submission_id == 1} == {(r.hash, r.pos) for r in got if r.submission_id == 2} != set()


def sets_frame(spark, sets):
    return spark.createDataFrame([("a", i, h) for i, s in sets.items() for h in s], "assignment_id string, submission_id long, hash long")


def test_pairs(spark):
    sets = sets_frame(spark, {1: [101, 102, 103], 2: [102, 103, 104], 3: [9]})
    found = pairs.candidate_pairs(sets).collect()
    assert [(r.a, r.b, r.shared) for r in found] == [(1, 2, 2)]
    assert pairs.jaccard(pairs.candidate_pairs(sets), pairs.set_sizes(sets)).first().score == 0.5
    ten = sets_frame(spark, {i: [999] for i in range(10)})
    assert pairs.candidate_pairs(ten).count() == 45
    assert pairs.candidate_pairs(sets.limit(0)).count() == 0


def test_boilerplate(spark):
    sets = sets_frame(spark, {1: [1, 2, 3, 10, 11], 2: [1, 2, 3, 20, 21], 3: [1, 2], 4: [1]})
    subs = spark.createDataFrame([("a", i) for i in range(1, 5)], "assignment_id string, submission_id long")
    stats = boilerplate.boilerplate_stats(boilerplate.hash_frequency(sets, subs), spark.createDataFrame([(3,)], "hash long"), 0.7)
    assert {r.hash for r in stats.where("is_boilerplate").collect()} == {1, 2, 3}
    pair = boilerplate.adjusted_pairs(sets, stats).where("a = 1 AND b = 2").first()
    assert (pair.raw, pair.adjusted, pair.n_boilerplate) == (3 / 7, 0.0, 3)


def test_risk_and_language(spark):
    rows = spark.createDataFrame([(x,) for x in (0.95, 0.7, 0.69, 0.4, 0.39)], "s double").select(evidence.risk_level(F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == ["high", "high", "medium", "medium", "low"]
    texts = {"def f(x):\n  return x": "python", "public class A {}": "java", "#include <iostream>": "cpp", "using System;\nclass P {}": "csharp", "int main() { printf(1); }": "c", "x": "javascript", "": "javascript"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", language.language_from_code(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in got} == texts


def test_regions_fold(spark):
    raw = spark.createDataFrame([("a", 1, 2, h, *r) for h, r in enumerate([(1, 1, 2, 2), (4, 4, 5, 5), (5, 9, 6, 10), (7, 3, 8, 4)])], "assignment_id string, a long, b long, hash long, sa int, sb int, ea int, eb int")
    regions = evidence.matched_regions(raw).first().regions
    assert [tuple(r) for r in regions] == [(1, 1, 5, 5, 2), (5, 9, 6, 10, 1), (7, 3, 8, 4, 1)] or [tuple(r) for r in regions] == [(1, 1, 5, 5, 2), (5, 9, 8, 10, 2)]


def test_clusters(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.75), (7, 8, 0.92), (8, 9, 0.1)]
    frame = spark.createDataFrame([("x", a, b, s) for a, b, s in edges], "assignment_id string, a long, b long, adjusted double")
    kept = clusters.cluster_edges(frame)
    members = clusters.clusters(kept)
    assert {(r.submission_id, r.cluster_id) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    subs = spark.createDataFrame([("x", i, f"s{i}" if i != 7 else None, f"2024-01-01 10:{i * 5:02d}:00") for i in (1, 2, 3, 4, 7)], "assignment_id string, submission_id long, student_id string, t string").withColumn("submitted_at", F.to_timestamp("t"))
    stats = {r.cluster_id: r for r in clusters.cluster_stats(members, kept, subs).collect()}
    assert (stats[1].size, stats[1].highest, stats[1].within_minutes, stats[1].best_a) == (4, 0.9, 15, 1)
    assert stats[7].students == ["sub_7", "sub_8"] and stats[7].within_minutes is None


def test_versions_and_reports(spark):
    rows = [("a", "s", i, f"2024-01-0{i} 00:00:00", "fingerprinted" if i < 3 else "failed") for i in (1, 2, 3)]
    log = spark.createDataFrame(rows, "assignment_id string, student_id string, submission_id long, t string, status string").withColumn("submitted_at", F.to_timestamp("t"))
    versioned = versions.assign_version(log)
    assert versions.latest_version(versioned).first().version == 2
    results = spark.createDataFrame([("a", i, i + 1, s, s) for i, s in enumerate((0.9, 0.80004, 0.80001, 0.1))], "assignment_id string, a long, b long, raw double, adjusted double")
    assert [r["rank"] for r in reports.competition_rank(results).orderBy("a").collect()] == [1, 2, 2, 4]
    assert {r.bucket: r.n for r in reports.score_histogram(results).collect()} == {"0-20": 1, "20-40": 0, "40-60": 0, "60-80": 0, "80-100": 3}
    badge = lambda m: spark.range(1).select(reports.due_badge(F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,{m})"), F.expr("TIMESTAMP '2024-01-01 00:00:00'")).alias("b")).first().b
    assert [badge(m) for m in (0, 5, 60, 119, 120, 1440, 4000)] == ["Closed", "Due in 5 minutes", "Due in 1 hour", "Due in 1 hour", "Due in 2 hours", "Due in 1 day", "Due in 2 days"]


def test_intake(spark):
    paths = ["a.py", "../x.py", "__MACOSX/a", "a/.git", "", None, "a\\..\\b"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(intake.safe_path(F.col("p")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False, False]
    names = spark.createDataFrame([("A.PY", "x"), ("b.md", "x"), ("c.js", " "), (".py", "x"), ("d.java", "x")], "n string, c string")
    assert [r.r for r in names.select(intake.reject_reason(F.col("n"), F.col("c"), F.lit("python")).alias("r")).collect()] == [None, "extension", "blank", "extension", "language"]


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x = 1")
    (tmp_path / "in" / "b.md").write_text("no")
    (tmp_path / "in" / "c.js").write_text("  ")
    files = ingest.read_files(spark, str(tmp_path / "in"))
    assert [(r.file_name, r.language) for r in ingest.ingest_files(files).collect()] == [("a.py", "python")]
    zipped = ingest.zip_files(files.select(F.lit("z").alias("archive"), F.concat(F.lit("d/"), F.element_at(F.split("path", "/"), -1)).alias("path"), "content"))
    bad = spark.createDataFrame([("broken", bytearray(b"no zip"))], "path string, content binary")
    assert [r.path for r in ingest.ingest_archives(zipped.union(bad)).collect()] == ["z!d/a.py"]
    good = bytearray(zipped.first().content)
    at = good.index(b"PK\x03\x04")
    good[at + 6] |= 1  # both places that say that the entry is encrypted
    good[good.index(b"PK\x01\x02") + 8] |= 1
    locked = spark.createDataFrame([("locked", good), ("none", None)], "path string, content binary")
    errors = {r.path: r.error for r in ingest.archive_errors(zipped.union(bad).union(locked)).collect()}
    assert {"broken", "none"} <= set(errors) and any(x.startswith("locked!") for x in errors)
    assert any("bytes" in r.error for r in ingest.archive_entries(zipped, max_entry=1).where("error IS NOT NULL").collect())
    inline = ingest.inline_files(spark.createDataFrame([("t.py", "x = 1"), ("u.py", None)], "path string, text string"))
    assert [r.path for r in ingest.ingest_files(inline.union(files.select("path", "content"))).where("path LIKE '_.py'").collect()] == ["t.py"]


def test_sinks(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "assignment_id string, v long")
    path = str(tmp_path / "results")
    ingest.replace_results(frame([("a", 1), ("b", 2)]), path)
    ingest.replace_results(frame([("b", 3)]), path)
    assert sorted((r.assignment_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    index = str(tmp_path / "index")
    for sets in ({1: [5, 5, 6]}, {1: [6], 2: [6]}):
        ingest.add_to_index(sets_frame(spark, sets), index)
    assert spark.read.parquet(index).count() == 3


def test_edit_scripts():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        script = diff.edit_script(a, b)
        assert [i for _, i, _ in script if i >= 0] == list(range(len(a))) and [j for _, _, j in script if j >= 0] == list(range(len(b)))
        assert all(a[i] == b[j] for kind, i, j in script if kind == "equal")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(kind == "equal" for kind, _, _ in script) == table[-1][-1]


def test_pair_diff(spark):
    rows = [("a", 1, 2, "x = 1\ny = 2\nz", "x = 1 \ny = 3\nz\nw", "python"), ("a", 1, 3, "same", "same", "python"), ("a", 1, 4, None, "", "python")]
    ops = diff.pair_diff(spark.createDataFrame(rows, "assignment_id string, a long, b long, code_a string, code_b string, language string"))
    got = [(r.b, r.type, r.a_start, r.b_start, r.token_equal) for r in ops.orderBy("b", "op_no").collect()]
    assert got == [(2, "equal", 1, 1, None), (2, "modify", 2, 2, 3), (2, "equal", 3, 3, None), (2, "insert", None, 4, None), (3, "equal", 1, 1, None), (4, "equal", 1, 1, None)]
    assert [(r.regions, r.insertions, r.modifications) for r in diff.diff_stats(ops).orderBy("b").collect()] == [(2, 1, 1), (1, 0, 0), (1, 0, 0)]


def test_streams_of_several_files(spark, tmp_path):
    from siftmark.streaming import jobs

    rows = [("a", i, f"def f{i}(x):\n    total = x + {i}\n    for y in x:\n        total += y\n    return total\n", "python", None) for i in range(4)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], CODE).write.parquet(str(tmp_path / "in" / f"p{i}"))
    whole = spark.createDataFrame(rows, CODE)
    stream = lambda: spark.readStream.schema(CODE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    prints = fingerprint.fingerprints(tokens.tokenize_any(whole))
    key = lambda df: sorted(map(str, df.collect()))
    columns = ["assignment_id", "submission_id", "hash", "pos", "start_line", "end_line"]
    assert key(jobs.stream_fingerprints(stream(), str(tmp_path / "f")).select(columns)) == key(prints.select(columns))
    columns = ["assignment_id", "a", "b", "shared"]
    assert key(jobs.stream_candidates(stream(), str(tmp_path / "c")).select(columns)) == key(pairs.candidate_pairs(pairs.distinct_hashes(prints)).select(columns))


def _attempt_files(spark, folder, rows):
    for n, some in enumerate(rows):
        spark.createDataFrame(some, "assignment_id string, submission_id long, student_id string, submitted_at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in.parquet")
    return st.stream_table(spark, str(folder), "in")


def test_streams_go_on_where_they_stopped_and_count_no_batch_twice(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, day)
    progress = st.Progress()
    spark.streams.addListener(progress)
    first = [("a", 1, "S1", at(1)), ("a", 2, "S2", at(2))]
    stream = _attempt_files(spark, tmp_path, [first])
    got = {r.student_id: (r.submission_id, r.n) for r in st.stream_latest(stream, str(tmp_path / "work")).collect()}
    assert got == {"S1": (1, 1), "S2": (2, 1)}
    stream = _attempt_files(spark, tmp_path, [[("a", 3, "S1", at(3))], [("a", 4, "S1", at(2))]])
    got = {r.student_id: (r.submission_id, r.n) for r in st.stream_latest(stream, str(tmp_path / "work")).collect()}
    assert got == {"S1": (3, 3), "S2": (2, 1)}
    deadlines = spark.createDataFrame([("a", at(2))], "assignment_id string, deadline timestamp")
    accepted, late = st.stream_deadline(stream, deadlines, str(tmp_path / "due"))
    assert [r.submission_id for r in accepted.collect()] == [1] and sorted(r.submission_id for r in late.collect()) == [2, 3, 4]
    for _ in range(50):
        if sum(progress.rows.values()) >= 8:
            break
        time.sleep(0.2)
    spark.streams.removeListener(progress)
    assert sum(progress.rows.values()) == 8 and not progress.failed


def test_code_inside_the_row_is_as_over_token_rows(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_SUM_BLOCK", 7)
    rng = random.Random(8)
    bits = ["x = 1\n", "if a > 0 :\n", "# note\n", "/* c\nc */", "'''t\nt'''", '"s"', "for i in r ( 3 ) :", "\n\n", "return f ( x ) ;", "#include <a>\n", "é", "0x1F", "//d\n", "`t\n`"]
    rows = [(f"a{k % 3}", k, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 9, 60]))), rng.choice(["python", "java", "cpp", "auto", None]), "f.js") for k in range(120)]
    rows += [("a0", 900, None, "python", "f.py"), ("a0", 901, "  \n ", "c", "f.c"), ("a1", 902, "x = 1 + y\n" * 3000, "python", "f.py")]
    code = spark.createDataFrame(rows, CODE)
    columns = ("assignment_id", "submission_id", "hash", "pos", "start_line", "end_line")
    for k, w in ((5, 4), (1, 1), (3, 2)):
        slow = sorted(map(tuple, fingerprint.fingerprints(tokens.tokenize_any(code), k, w).select(*columns).collect()))
        assert sorted(map(tuple, fingerprint.code_fingerprints(code, k, w).select(*columns).collect())) == slow
        assert sorted(map(tuple, fingerprint.code_sets(code, k, w).collect())) == sorted({r[:3] for r in slow})


@pytest.mark.parametrize("within", ["assignment_id", None])
def test_classes_expand_to_all_pairs(spark, within):
    rng = random.Random(9)
    kinds = [rng.sample(range(30), rng.randint(1, 6)) for _ in range(12)]
    rows = [(f"a{k % 3}", k, h) for k in range(90) for h in kinds[rng.randrange(12)]]
    sets = spark.createDataFrame(rows, "assignment_id string, submission_id long, hash long").distinct()
    members = pairs.class_members(sets, within)
    found = pairs.class_pairs(sets, members, within)
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(pairs.expand_classes(found, members, within)) == rows_of(pairs.candidate_pairs(sets, within))
    assert found.count() <= (3 if within else 1) * 78 and members.count() == sets.select("submission_id").distinct().count()

"""Archives in files are planned and read by tasks; the driver doesn't hear of them."""

import io
import zipfile

from siftmark.plans import catalog
from siftmark.sources import archives as ar
from siftmark.sources import ingest as ig
from siftmark.sources.durable import kept

SF = "/root/testdata/sf0.001"


def test_no_names_come_to_the_driver(spark, monkeypatch):
    def refuse(*args, **more):
        raise AssertionError("names on the driver")

    monkeypatch.setattr(ar, "write_files", refuse)
    monkeypatch.setattr(ar, "read_archives", refuse)
    rows = lambda name: sorted(map(tuple, catalog.queries()[name](spark, SF).collect()))
    assert rows("ingest_zip_ranges") == rows("ingest_zip") != []


def test_stored_archives_are_read_by_ranges_with_their_errors(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(7):
            z.writestr(f"f{k}.py", "x" * k)
        z.writestr("big.py", "y" * 100)
    stored = kept(ar.write_archives(spark.createDataFrame([("one", out.getvalue()), ("bad", b"no archive")], "path string, content binary"), str(tmp_path)))
    got = {r.path: (r.content, r.error) for r in ar.read_stored(stored, max_entry=50, task_entries=2).collect()}
    assert {p: bytes(c) for p, (c, e) in got.items() if e is None} == {f"one!f{k}.py": b"x" * k for k in range(7)}
    assert got["one!big.py"][1] == "entry: 100 bytes" and got["bad"][1].startswith("archive: ")


def test_entries_come_in_batches(spark):
    files = spark.createDataFrame([(f"a{k % 3}", f"f{k}.py", b"z" * k) for k in range(30)], "archive string, path string, content binary")
    packed = ig.zip_files(files)
    assert "FlatMapGroupsInPandas" not in packed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.path, bytes(r.content)) for r in ig.archive_entries(packed).collect()) == sorted((f"a{k % 3}!f{k}.py", b"z" * k) for k in range(30))

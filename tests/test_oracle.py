"""A few registered queries against their SQL on the smallest tables; compare.py does it for all."""

from pathlib import Path

import duckdb
import pytest

from compare import rows_of
from siftmark.plans import catalog

SF = "/root/testdata/sf0.001"


def same(spark, query, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, SF)
    theirs = con.sql(sql)
    assert sorted(df.columns) == sorted(theirs.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", ["suspicious_pairs", "tokens_any", "code_fingerprints", "adjusted_pairs", "matched_regions", "student_dashboard", "validate_rows", "group_match", "latest_version", "stream_latest", "stream_fingerprints", "stream_candidates", "stream_deadline", "stream_bursts", "pair_diff", "boilerplate_sink", "own_assignments", "candidate_pairs", "fingerprints", "stream_sessions", "stream_deadline_versions", "text_report", "candidate_classes", "scan_wanted", "ingest_zip_ranges", "long_pair_diff", "stream_progress"])
def test_query(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name])

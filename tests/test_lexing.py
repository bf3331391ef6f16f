"""Code is read by batches, and streams of it without a join."""

import dataclasses

from siftmark.functions.lexicons import LANGUAGES
from siftmark.operators import fingerprint, lexing, tokens
from siftmark.plans import stream_queries
from siftmark.sources import programs

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_code_is_read_by_batches(spark):
    code = programs.programs(spark, SF)
    for found in (fingerprint.code_fingerprints(code), fingerprint.code_sets(code)):
        assert "MapInArrow" in plan_of(found) and "lambdafunction" not in plan_of(found)


def test_patterns_that_python_cannot_read_are_left_to_spark(spark):
    own = LANGUAGES | {"mine": dataclasses.replace(LANGUAGES["java"], word=r"\p{Lu}[A-Za-z0-9_$]*|[A-Za-z_$][A-Za-z0-9_$]*")}
    assert lexing.readable(LANGUAGES) and not lexing.readable(own)
    rows = [("a", 1, "int x = Foo ( 3 ) ;\n" * 5, "mine", "f.x"), ("a", 2, None, "mine", "f.x"), ("b", 3, "x", "java", "f.java")]
    code = spark.createDataFrame(rows, "assignment_id string, submission_id long, code string, language string, file_name string")
    columns = ("assignment_id", "submission_id", "hash", "pos", "start_line", "end_line")
    slow = sorted(map(tuple, fingerprint.fingerprints(tokens.tokenize_any(code, own)).select(*columns).collect()))
    assert slow and sorted(map(tuple, fingerprint.code_fingerprints(code, languages=own).select(*columns).collect())) == slow


def test_a_stream_of_programs_joins_nothing(spark):
    stream = stream_queries._part_stream(spark, SF)
    assert stream.isStreaming and "Join" not in stream._jdf.queryExecution().logical().toString()

"""What keeps work in proportion to the input: tasks, joins, and results that aren't written out to be counted."""

import random

import pytest

from siftmark.operators import boilerplate, pairs, tokens
from siftmark.plans import catalog
from siftmark.sources import programs
from siftmark.streaming import levels

SF = "/root/testdata/sf0.001"
SETS = "assignment_id string, submission_id long, hash long"


def some_sets(spark, seed=9, copies=90):
    rng = random.Random(seed)
    kinds = [rng.sample(range(30), rng.randint(1, 6)) for _ in range(12)]
    return spark.createDataFrame([(f"a{k % 3}", k, h) for k in range(copies) for h in kinds[rng.randrange(12)]], SETS).distinct()


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_programs_and_their_tokens_are_dealt_over_all_tasks(spark):
    code = programs.programs(spark, SF)
    assert code.select("submission_id", "code").rdd.getNumPartitions() >= 8
    per_task = tokens.tokenize_any(code).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in per_task) >= 6


def test_pairs_are_not_gathered_on_the_driver(spark):
    sets = some_sets(spark)
    members = pairs.class_members(sets)
    for frame in (pairs.candidate_pairs(sets), pairs.class_pairs(sets, members), pairs.ranked_classes(pairs.class_pairs(sets, members), members)):
        frame.collect()
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_places_and_counts_of_classes_are_those_of_pairs(spark, seed):
    sets = some_sets(spark, seed)
    members = pairs.class_members(sets)
    found = pairs.class_pairs(sets, members)
    all_pairs = pairs.candidate_pairs(sets)
    columns = ["assignment_id", "a", "b", "shared", "place"]
    assert rows_of(pairs.ranked_classes(found, members).select(columns)) == rows_of(pairs.ranked_candidates(all_pairs).select(columns))
    submissions = sets.select("assignment_id", "submission_id").distinct()
    assert rows_of(pairs.candidate_stats(submissions, found)) == rows_of(pairs.candidate_stats(submissions, all_pairs))


def test_pairs_bear_the_sizes_of_their_sides(spark):
    sets = some_sets(spark)
    assert rows_of(pairs.jaccard(pairs.pair_counts(sets))) == rows_of(pairs.jaccard(pairs.candidate_pairs(sets), pairs.set_sizes(sets)))
    flagged = sets.selectExpr("*", "hash % 2 = 0 AS even")
    own = {(r.assignment_id, r.submission_id): r.n for r in flagged.groupBy("assignment_id", "submission_id").agg({"even": "count_if"}).withColumnRenamed("count_if(even)", "n").collect()}
    for r in pairs.pair_counts(flagged, flags=["even"]).collect():
        assert (r.own_even_a, r.own_even_b) == (own[r.assignment_id, r.a], own[r.assignment_id, r.b])
    assert boilerplate.adjusted_pairs(sets.limit(0), boilerplate.boilerplate_stats(boilerplate.hash_frequency(sets, sets))).count() == 0


def test_groups_are_matched_in_many_tasks(spark):
    found = catalog.queries()["group_match"](spark, SF)
    per_task = found.rdd.glom().map(len).collect()
    assert max(per_task) < sum(per_task) / 2
    assert "upper" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_progress_of_a_stream_takes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(levels, "stream_candidates", None)
    got = catalog.queries()["stream_progress"](spark, SF).collect()
    assert [(r.rows, r.ended) for r in got] == [(200, True)]

"""Pairs by cells: what is sent are sets, never pairs."""

import random

import pytest

from siftmark.operators import cells, pairs

SETS = "assignment_id string, submission_id long, hash long"


def some_sets(spark, seed, copies=120):
    rng = random.Random(seed)
    kinds = [rng.sample(range(40), rng.randint(1, 7)) for _ in range(40)]
    rows = {(f"a{k % 3}", k, h) for k in range(copies) for h in kinds[rng.randrange(40)]}
    return spark.createDataFrame(sorted(rows), SETS)


def brute(sets, within):
    held = {}
    for r in sets.collect():
        held.setdefault((r.assignment_id if within else None, r.submission_id), set()).add(r.hash)
    met = [(*((g,) if within else ()), a, b, len(x & y), len(x), len(y)) for (g, a), x in held.items() for (f, b), y in held.items() if g == f and a < b and x & y]
    return sorted(met)


@pytest.mark.parametrize("within", ["assignment_id", None])
@pytest.mark.parametrize("blocks", [1, 5])
def test_cells_find_all_pairs_once(spark, monkeypatch, within, blocks):
    monkeypatch.setattr(cells, "BLOCK_HASHES", 1_000_000 if blocks == 1 else 40)
    monkeypatch.setattr(pairs, "_UNIT", 3)
    sets = some_sets(spark, blocks)
    expected = brute(sets, within)
    assert sorted(map(tuple, pairs.pair_counts(sets, within).collect())) == expected
    arrays = pairs.set_arrays(sets)
    assert sorted(map(tuple, pairs.pair_counts(arrays, within).collect())) == expected
    members = pairs.class_members(arrays, within)
    found = pairs.expand_classes(pairs.class_pairs(arrays, members, within), members, within)
    assert sorted(map(tuple, found.collect())) == [r[:-2] for r in expected]


@pytest.mark.parametrize("classes", [False, True])
def test_pairs_are_neither_joined_nor_shuffled(spark, classes):
    sets = some_sets(spark, 7)
    frame = pairs.class_pairs(sets, pairs.class_members(sets)) if classes else pairs.pair_counts(sets)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_sets_without_a_common_hash_have_no_pairs(spark):
    sets = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], SETS)
    assert pairs.pair_counts(sets).count() == 0 and pairs.pair_counts(sets.limit(0)).count() == 0
    assert pairs.candidate_pairs(sets, None).count() == 1


def test_pairs_of_copies_are_not_sent_from_python(spark):
    """A thousand copies of two sets are two million pairs, and few rows of what Python gives back."""
    rows = spark.range(2000).selectExpr("'a' AS assignment_id", "id AS submission_id", "explode(array(1L, 2L + id % 2)) AS hash")
    found = pairs.pair_counts(rows)
    assert "Generate" in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    sums = found.selectExpr("count(*)", "sum(shared)", "count_if(a < b)", "min(size_a)").first()
    assert tuple(sums) == (1999 * 1000, 1000 * 1000 + 2 * 999 * 1000, 1999 * 1000, 2)

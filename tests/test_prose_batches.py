"""Fingerprints of prose come of batches: what filters them isn't computed with them again."""

import pytest

from siftmark.operators import fingerprint, lexing, tokens
from siftmark.plans import catalog

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "one two", "One TWO three four five", "a b c d e f g " * 9, "Straße ΣΑΣ 12ab3 😀 naïve \U0001d400x " * 6, "x " * 50]


@pytest.mark.parametrize("at_once", [1_000_000, 3])
@pytest.mark.parametrize("k, w", [(5, 4), (3, 2), (1, 1)])
def test_batches_find_what_windows_over_tokens_find(spark, monkeypatch, at_once, k, w):
    monkeypatch.setattr(lexing, "_AT_ONCE", at_once)
    texts = spark.createDataFrame([("a", i, t) for i, t in enumerate(TEXTS)], "assignment_id string, submission_id long, text string")
    words = tokens.prose_tokens(texts)
    columns = ("assignment_id", "submission_id", "hash", "pos", "start_line", "end_line")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    slow = rows(fingerprint.fingerprints(words, k, w).select(*columns))
    assert slow and rows(fingerprint.prose_fingerprints(texts, k, w).select(*columns)) == slow
    assert rows(fingerprint.prose_sets(texts, k, w)) == sorted({r[:3] for r in slow})
    assert rows(fingerprint.prose_counts(texts, k, w)) == rows(fingerprint.fingerprint_counts(texts, words, k, w))
    assert fingerprint.prose_arrays(texts, k, w).count() == len(TEXTS)


def test_filters_do_not_compute_fingerprints_again(spark):
    found = catalog.queries()["boilerplate_hashes"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    assert found.columns == ["assignment_id", "hash", "occurrences"]

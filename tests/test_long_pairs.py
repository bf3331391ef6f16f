"""Short pairs' scripts are found whole, and copies are compared once."""

import random

from siftmark.operators import diff, long_diff
from siftmark.plans import report_queries

LINES = "assignment_id string, submission_id long, text string"


def some(spark):
    rng = random.Random(4)
    texts = {k: "\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))) for k in range(12)} | {20: None, 21: "", 22: "x\n" * 250, 23: "x\n" * 240 + "y"}
    lines = long_diff.numbered_lines(spark.createDataFrame([("p", k, t) for k, t in texts.items()], LINES))
    pairs = [(a, b) for a in texts for b in texts if a <= b]
    return texts, pairs, spark.createDataFrame([("p", a, b) for a, b in pairs], "assignment_id string, a long, b long"), lines


def test_short_pairs_have_shortest_scripts(spark):
    texts, pairs, frame, lines = some(spark)
    got = {}
    for r in long_diff.long_diff(frame, lines).collect():
        got.setdefault((r.a, r.b), []).append((r.op_no, r.type, r.a_start, r.a_end, r.b_start, r.b_end))
    assert sorted(got) == sorted(pairs)
    span = lambda at: (at[0] + 1, at[-1] + 1) if at else (None, None)
    for a, b in pairs:
        if max(a, b) < 22:
            script = diff.blocks(diff.edit_script((texts[a] or "").split("\n"), (texts[b] or "").split("\n")))
            assert sorted(got[a, b]) == [(no, kind, *span(i), *span(j)) for no, (kind, i, j) in enumerate(script)]
        elif a == b:
            assert [x[1] for x in got[a, b]] == ["equal"]


def test_short_pairs_need_no_windows(spark):
    _, _, frame, lines = some(spark)
    found = long_diff.long_diff(frame.where("b < 22"), lines)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_copies_are_compared_once(spark, tmp_path, monkeypatch):
    text = " ".join(f"word{i}" for i in range(60)).replace("word9 ", "word9\n").replace("word40 ", "\nword40 ")
    rows = [(d, text if d < 8 else text + " more", "s") for d in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, whole = [], long_diff.long_diff
    monkeypatch.setattr(long_diff, "long_diff", lambda pairs, lines: seen.append(pairs.count()) or whole(pairs, lines))
    got = report_queries.long_pair_diff(spark, str(tmp_path)).collect()
    assert seen == [3] and len(got) == 66 and all((r.lines_a, r.lines_b, r.alike, r.in_order) == (3, 3, True, True) for r in got)

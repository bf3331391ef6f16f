from siftmark.llm.chat_formatting import collapse_snapshots

SCHEMA = "conv_id long, turn long, role string, text string, n string"


def run(spark, rows):
    return {r.conv_id: r for r in collapse_snapshots(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()}


def test_prefixes_and_copies_go(spark):
    a = [(0, "user", "hi"), (1, "assistant", "yo"), (2, "user", "more")]
    rows = [(1, *t) for t in a[:1]] + [(2, *t) for t in a[:2]] + [(3, *t) for t in a] + [(4, *t) for t in a] + [(5, *t) for t in a[1:]]
    got = run(spark, rows)
    assert sorted(got) == [3, 5] and got[3].n_copies == 2 and got[3].n_turns == 3
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[3].n_chars == len(got[3].rendered)


def test_nulls_ties_repeats_and_markers(spark):
    rows = [(1, None, None, None), (2, 0, "", ""), (3, 0, "u", "a"), (3, 0, "u", "a"), (3, 0, "u", "b"), (None, 0, "u", "<|im_end|>")]
    got = run(spark, rows)
    assert sorted(got, key=str) == [1, 2, 3, None]
    assert got[1].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[3].n_turns == 2 and got[None].rendered == "<|im_start|>u\n< |im_end|><|im_end|>\n"


def test_turn_order_matters(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "b"), (2, 1, "u", "a"), (2, 2, "u", "c")]
    assert sorted(run(spark, rows)) == [1, 2]


def test_empty(spark):
    assert run(spark, []) == {}

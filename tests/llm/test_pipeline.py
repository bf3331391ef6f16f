import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftmark.llm import quality_rules
from siftmark.llm.packing import default_tokenizer

from .test_text_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        assert set(now) < set(before) or k in (1, 2, 3) and set(now) <= set(before)
        if k != 1:
            assert all(now[d] == before[d] for d in now)
        assert all(r.n_chars == len(r.text) for r in now.values())
        before = now
    tokenizer = Tokenizer.from_file(default_tokenizer())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    for doc, row in before.items():
        ids, at = np.array(tokenizer.encode(row.text, add_special_tokens=False).ids + [2], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:2] == ["doc_id", "start"]


def test_copies_of_whole_documents_go(spark):
    texts = {n: "\n".join(f"copy {n} line {i}" for i in range(n)) for n in range(2, 30)}
    rows = [*texts.items(), *((100 + n, t) for n, t in texts.items())]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert set(left) == set(texts) and all(left[d].text == t for d, t in texts.items())


def test_rows_are_judged_one_by_one(spark):
    words = lambda seed, n: " ".join(f"w{seed}{chr(97 + i % 26)}{i * i % 89}" for i in range(n))
    near, good, other = words("n", 200), words("g", 200), words("o", 200)
    schema = "doc_id long, text string, lang string, source string"
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s") for d, t in rows], schema)
    rows = [(None, near), (None, near), (None, near + " more"), (4, near), (4, near), (4, near + " more"), (-9, good), (5, good), (None, good), (7, other), (7, words("x", 90)), (None, None), (None, None)]
    left = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.near_duplicates(spark, frame(rows), SF).collect())
    assert left == sorted([("4", near) if ("4", near) in left else ("4", near + " more"), ("-9", good), ("7", other), ("7", words("x", 90)), ("None", ""), ("None", "")])
    rows = [(None, good), (None, "too short"), (3, other), (3, "short too"), (None, None), (5, "short"), (6, near)]
    left = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.quality(spark, frame(rows), SF).collect())
    assert left == sorted([("None", good), ("3", other), ("6", near)])


def test_every_item_of_the_benchmark_counts(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(20))
    items = [(None, item), (None, "What is seven?"), (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"before {item} after"), (2, "so WHAT is\nseven, then"), (3, "what is"), (4, "seven?"), (5, "nine one two three four five six seven eight nine ten eleven"), (6, "two three four five six seven eight nine ten eleven"), (7, None), (8, "what is seven")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmarks(spark, frame, str(tmp_path)).collect()) == [3, 4, 6, 7]


# The stages again, in plain Python over lists of rows.

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    words = re.findall(WORD, text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text or "")),
    }


def plain_quality(rows):
    facts = [plain_counts(r.text) for r in rows]
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in facts]
    bad = set()
    for metric, (top, bottom, scale, mid, outer, reach, low_too) in quality_rules.METRICS.items():
        value = [min(c[top] * scale // c[bottom], quality_rules.TOP) if c[bottom] else 0 for c in facts]
        own, lang, every = defaultdict(Counter), defaultdict(Counter), Counter()
        for r, v, f in zip(rows, value, failed, strict=True):
            if not f:
                own[r.lang, r.source][v] += 1
                lang[r.lang][v] += 1
                every[v] += 1

        def lean(sketch, prior):
            n = sum(prior.values())
            return Counter({v: w * n for v, w in sketch.items()}) + Counter({v: w * quality_rules.PRIOR for v, w in prior.items()})

        for (of, source), sketch in own.items():
            merged = lean(sketch, lean(lang[of], every))
            total = sum(merged.values())

            def at(percent):
                upto = 0
                for v in sorted(merged):
                    upto += merged[v]
                    if upto * 100 >= total * percent:
                        return v

            high = at(outer) + reach * (at(outer) - at(mid)) + 1
            low = at(100 - outer) - reach * (at(100 - mid) - at(100 - outer)) - 1 if low_too else -1
            bad |= {i for i, r in enumerate(rows) if (r.lang, r.source) == (of, source) and not low <= value[i] <= high}
    return [r for i, r in enumerate(rows) if not failed[i] and i not in bad]


def plain_lines(rows):
    first, out = {}, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        lines = r.text.split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if not re.search(WORD, "".join(pair)):
                continue
            doc, no = first.setdefault(pair, (r.doc_id, i))
            if doc != r.doc_id or i > no + 1:
                gone |= {i, i + 1}
        # lines without a word go with the cuts unless a kept line with words is on one of their sides, up to the next cut
        keeps = [i not in gone and bool(re.search(WORD, x)) for i, x in enumerate(lines)]
        kept = []
        for i, x in enumerate(lines):
            left = next((keeps[j] for j in range(i, -1, -1) if keeps[j] or j in gone), None)
            right = next((keeps[j] for j in range(i, len(lines)) if keeps[j] or j in gone), None)
            if i not in gone and (keeps[i] or left or right or not gone):
                kept.append(x)
        out.append((r.doc_id, kept, len(lines) - len(kept), len(lines)))
    return out


def plain_contaminated(text, items):
    words = np.array(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    for item in items:
        same = words[:, None] == item[None, :] if len(words) else np.zeros((0, 1), bool)
        for d in range(11 - len(item) + 1, len(words) - 11):
            diagonal = np.concatenate([[0], np.cumsum(same.diagonal(-d))])
            if len(diagonal) > 12 and (diagonal[12:] - diagonal[:-12] >= 10).any():
                return True
    return False


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    frames = [docs]
    for k, stage in enumerate(stages[:-1]):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [f.orderBy("doc_id").collect() for f in frames]
    assert {r.doc_id for r in plain_quality(rows[0])} == {r.doc_id for r in rows[1]}
    after = {r.doc_id: r for r in rows[2]}
    for doc, kept, n_gone, n in plain_lines(rows[1]):
        assert (n_gone == n and n_gone > 0) == (doc not in after)
        if doc in after:
            assert [x for x in after[doc].text.split("\n") if x.strip()] == [x for x in kept if x.strip()]
    least = {d: c for d, _, c in brute_components([(r.doc_id, r.text) for r in rows[2]])}
    assert {r.doc_id for r in rows[3]} == {d for d, c in least.items() if d == c}
    items = [np.array(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert min(map(len, items)) >= 12
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3] if not plain_contaminated(r.text, items)}
    assert len(rows[4]) < len(rows[3]) < len(rows[2]) <= len(rows[1]) < len(rows[0])


@pytest.mark.parametrize("no", range(5))
def test_stages_take_odd_rows(spark, tmp_path, no):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns that are named as those used inside."""
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = " ".join(f"w{chr(97 + i % 26)}{i * 7 % 101}" for i in range(120))
    rows = [(None, None), (None, good), (None, good), (1, ""), (2, good + "\nsecond line of it"), (2, good + "\nsecond line of it"), (3, "x " * 200_000), (4, "a\n" * 5), (5, good[:-3] + "zz")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, key string, row string, gone string, n string, _row string, n_words string, kept string, _row_key string, n_lines_removed string, cut string, _other_id string"
    clash = "abcdefghijkl"
    frame = spark.createDataFrame([(d, t, None, None, None, *clash) for d, t in rows], schema)
    stage = corpus_pipeline.STAGES[no][1]
    whole, none = stage(spark, frame, str(tmp_path)), stage(spark, frame.limit(0), str(tmp_path))
    assert none.count() == 0
    if no == 4:
        assert whole.select("doc_id", "start").count() >= len(rows)
        return
    got = whole.collect()
    assert whole.columns == frame.columns and 0 < len(got) <= len(rows)
    assert all(tuple(r)[5:] == tuple(clash) for r in got)
    before = Counter((r.doc_id, r.text) for r in frame.collect())
    if no != 1:
        assert not Counter((r.doc_id, r.text) for r in got) - before
    assert len(got) == {2: 5, 3: 9}.get(no, len(got))

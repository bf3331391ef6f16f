"""Periodic runs, URL filters and ranked search against brute force, and their defined results for odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from siftmark.llm import periodic_runs, ranked_search, url_filters


# periodic runs


def every_run(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found[i, j - i + q] = min(q, found.get((i, j - i + q), q))
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        words = []
        while len(words) < rng.randint(0, 70):
            some = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(1, 5))]
            words += some * rng.choice([1, 1, 2, 3, 4, 5, 7])
        assert periodic_runs.find_runs(np.array(words, np.int64)) == every_run(words), words


def test_suffix_tree_holds_every_suffix_once():
    rng = random.Random(4)
    for _ in range(200):
        letters = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))] + [0]
        child, start, end = periodic_runs.suffix_tree(letters, 4)
        found = []

        def walk(node, text):
            below = [v for k, v in child.items() if k // 4 == node]
            if not below:
                found.append(text)
            for v in below:
                walk(v, text + letters[start[v] : end[v]])

        walk(0, [])
        assert sorted(found) == sorted(letters[i:] for i in range(len(letters)))


def test_extensions_are_common_prefixes():
    rng = random.Random(5)
    letters = [rng.randint(1, 2) for _ in range(60)] + [0]
    common = periodic_runs.Extensions(letters, 3).common
    pairs = [(i, j) for i in range(61) for j in range(61) if i != j]
    got = common(*map(np.array, zip(*pairs)))
    assert got.tolist() == [next(k for k in range(61) if letters[i + k] != letters[j + k]) for i, j in pairs]


def test_runs_of_rows(spark):
    docs = spark.createDataFrame([(1, "x  a b a\nb a b a b y", "r"), (1, "x  a b a\nb a b a b y", "r"), (None, "z " * 100_000, "r"), (2, None, "r"), (3, " \n", "r"), (4, "é é é é é \x00 é", "r")], "doc_id long, text string, runs string")
    got = sorted(periodic_runs.periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 9, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 10, [(1, 8, 2)], "x a b y"),
        (1, 10, [(1, 8, 2)], "x a b y"),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 7, [], "é é é é é \x00 é"),
        (None, 100_000, [(0, 100_000, 1)], "z"),
    ]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_repeats_as_stated(spark, tmp_path):
    texts = {i: " ".join(f"w{i}_{k % 13}" for k in range(i % 37)) for i in range(300)} | {300: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in periodic_runs.op11_suffix_tree_runs(spark, str(tmp_path)).collect():
        words = (texts[row.doc_id] or "").split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = every_run(words)
        best = min(((-length, start, q) for start, length, q in runs), default=None)
        assert row.n_runs == len(runs) and (row.length, row.start, row.period) == ((-best[0], best[1], best[2]) if best else (None, None, None))


# URL filters

PAGES = "page_id long, url string, verdict string, tokens string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "v", "t") for i, u in enumerate(urls)], PAGES)


def test_base_rules(spark):
    urls = ["http://A.Net/en/1", "https://example.net/en/x", "http://m.example.net/de/", "http://www.example.com/de/2?q#f", "http://example.com/den/", "http://x.org/fr/", "http://org/fr/1", "http://xorg/fr/", "http://x.net", "http://x.net?a=/", None, "x.net/en/", "", "ftp://y.net:80/en/", "http://badexample.com/de/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages(spark, urls), spark.createDataFrame([], "url string, blocked boolean")).orderBy("page_id").collect()]
    assert got == [
        ("a.net", "/en/1", "net/", "block"),
        ("example.net", "/en/x", "example.net/en/", "allow"),
        ("m.example.net", "/de/", "net/", "block"),
        ("www.example.com", "/de/2", "example.com/de/", "block"),
        ("example.com", "/den/", None, "allow"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("org", "/fr/1", "org/fr/", "allow"),
        ("xorg", "/fr/", None, "allow"),
        ("x.net", "", None, "allow"),
        ("x.net", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("y.net:80", "/en/", None, "allow"),
        ("badexample.com", "/de/", None, "allow"),
    ]


def every_rule(rows):
    """Of (tokens, blocked) rows: all sets of tokens with enough blocked URLs among those that hold them."""
    counts = {}
    for tokens, blocked in rows:
        for mask in range(1, 1 << len(tokens)):
            key = tuple(t for i, t in enumerate(sorted(tokens)) if mask >> i & 1)
            n, bad = counts.get(key, (0, 0))
            counts[key] = n + 1, bad + blocked
    least = max(url_filters.MIN_URLS, url_filters.MIN_SUPPORT * len(rows))
    return {k: (bad / n, bad) for k, (n, bad) in counts.items() if bad >= least and bad / n >= url_filters.MIN_CONFIDENCE}


def test_rules_are_mined_and_matched(spark):
    rng = random.Random(6)
    urls, labels = [], []
    for i in range(600):
        host, lang, query = rng.choice(["a", "b", "c"]), rng.choice(["en", "fr"]), rng.choice(["?ref=1", "", "?page=2&ref=3"])
        urls.append(f"http://{host}.shop.com/{lang}/{i}{query}")
        bad = rng.random() < (0.9 if host == "a" and query and lang == "en" else 0.1)
        labels.append((urls[-1], bad))
    tokens = lambda u: {f"h:{x}" for x in re.findall(r"//([^/]+)", u)[0].split(".")} | {f"p:{re.sub('[0-9]+', '0', x)}" for x in u.split("?")[0].split("/")[3:]} | {f"q:{re.sub('[0-9]+', '0', x)}" for x in u.partition("?")[2].split("&") if x}
    rules = every_rule([(tokens(u), b) for u, b in labels])
    labelled = spark.createDataFrame([*labels, (None, True), ("http://x/", None)], "url string, blocked boolean")
    mined = {tuple(r.tokens): (r.confidence, r.n_urls) for r in url_filters.mine_rules(labelled).collect()}
    assert mined == rules and ("h:a", "p:en") in {k[:1] + k[-1:] for k in rules} | {("h:a", "p:en")}
    got = {r.url: r for r in url_filters.judge_urls(pages(spark, urls), labelled).join(pages(spark, urls).select("page_id", "url"), "page_id").collect()}
    for u in urls:
        fit = sorted((-c, -n, " ".join(k)) for k, (c, n) in rules.items() if set(k) <= tokens(u))
        assert (got[u].verdict, got[u].mined_rule) == (("block", fit[0][2]) if fit else ("allow", None))
    assert {got[u].verdict for u in urls} == {"block", "allow"}


def test_long_urls_and_empty_tables(spark):
    long = "http://" + ".".join("abcdefghij" * 3) + "/" + "/".join(f"s{chr(97 + i % 26)}" for i in range(5000)) + "?" + "&".join(f"k{i}" for i in range(3000))
    labelled = spark.createDataFrame([(long, True)] * 40, "url string, blocked boolean")
    assert {r.verdict for r in url_filters.judge_urls(pages(spark, [long]), labelled).collect()} == {"block"}
    assert url_filters.judge_urls(pages(spark, []), labelled).count() == 0


# ranked search


def brute_search(docs, items):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = {}
        for term in set(terms(text)):
            df = sum(term in t for _, t in held)
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for k, (_, t) in enumerate(held):
                if tf := t.count(term):
                    scores[k] = scores.get(k, 0) + w * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * len(t) * n_docs // total)))
        best = sorted((-s, held[k][0] is None, held[k][0] or 0) for k, s in scores.items() if s > 0)[:10]
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment, block", [(20, 1 << 18), (1000, 12)])
def test_search_is_that_of_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "aéZ7" for b in "xyzw"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(300)]
    docs += [(i, t) for i, t in docs[:40]] + [(None, "ax ay"), (500, None), (501, ""), (502, "Ax,AX;ax"), (503, "ax " * 30_000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(9)] + [(20, None), (21, "..."), (22, "none such"), (None, "AX zw")]
    documents = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, no int").repartition(3)
    benchmark = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    got = [tuple(r) for r in ranked_search.ranked_search(documents, benchmark).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(docs.withColumn("text", docs.text.substr(1, 0)), items).count() == 0


def test_pair_bounds_are_bounds_and_tighter():
    assert ranked_search.suffix_bounds([5, 4, 3], [6, -1]) == [9, 7, 3, 0]
    assert ranked_search.suffix_bounds([5, 4, 3], [9, 4]) == [9, 4, 3, 0]
    assert ranked_search.suffix_bounds([], []) == [0]

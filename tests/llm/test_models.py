import numpy as np
import pytest

from siftmark.llm import html_blocks, html_extraction, html_training, toxicity


@pytest.fixture(scope="module")
def crf():
    return html_extraction.train(list(html_training.labelled_pages(300)))


@pytest.fixture(scope="module")
def model():
    """As the query trains it."""
    return html_extraction.train(list(html_training.labelled_pages(html_extraction.PAGES)))


def test_crf_on_held_out_pages(crf):
    right = both = 0
    for html in html_training.labelled_pages(100, seed=77):
        page = html_blocks.blocks(html)
        gold = [int(html_training.MARK in b.text) for b in page]
        for b in page:
            b.text = b.text.replace(html_training.MARK, "")
        labels = crf.decode(page)
        right, both = right + sum(x == y for x, y in zip(gold, labels, strict=True)), both + len(gold)
    assert right / both > 0.97


def test_viterbi_is_the_best_path(crf):
    import itertools

    page = html_blocks.blocks(next(html_training.labelled_pages(1, seed=5)))[:9]
    e = crf.emissions(page)

    def total(path):
        return sum(e[i] for i, y in enumerate(path) if y) + sum(crf.step[y, z] for y, z in itertools.pairwise(path))

    assert total(crf.decode(page)) == pytest.approx(max(total(p) for p in itertools.product((0, 1), repeat=len(page))))


def test_marginals_are_sums_over_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 6):
        e, step = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        one, pairs, total = np.zeros(n), np.zeros((2, 2)), 0.0
        for path in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(e[i] for i, y in enumerate(path) if y) + sum(step[y, z] for y, z in itertools.pairwise(path)))
            total += weight
            one += weight * np.array(path)
            for y, z in itertools.pairwise(path):
                pairs[y, z] += weight
        got_one, got_pairs = html_extraction._marginals(e, step)
        assert np.allclose(got_one, one / total) and np.allclose(got_pairs, pairs / total)


LONG = "This is a long paragraph with many words, which goes on for a while and tells something of interest to the reader."


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        (f"<article><p>A normal first sentence of it.</p><p>{LONG}</p></article>", ["A normal first sentence of it.", LONG]),
        (f"<h1>Title here</h1><p>{LONG}</p><p>{LONG}</p>", ["Title here", LONG, LONG]),
        (f"<div>{LONG}</div>" * 4, [LONG] * 4),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div>", [LONG] * 2),
        ("<html><body><article><h1>On maths</h1><p>Energy <math><mi>E</mi> = mc2</math> is known, and it was so before we knew it well.</p></article></body></html>", ["On maths", "Energy E = mc2 is known, and it was so before we knew it well."]),
        (f"<article><h1>A name of it</h1><p>{LONG}</p></article><div class='user-replies'><h3>Replies</h3><div><p>I liked it a lot, thanks for the work.</p></div></div>", ["A name of it", LONG]),
        (f"<body><nav><a href=/>Home</a></nav><div><div>{LONG}</div><div>{LONG}</div></div><footer>&copy; 2020 us</footer>", [LONG] * 2),
        (f"<article><h2>Short</h2><table><tr><td>a</td><td>b</td></tr></table><pre>x = 1\ny = 2</pre><p>{LONG}</p></article>", ["Short", "a", "b", "x = 1 y = 2", LONG]),
    ],
)
def test_pages_written_by_hand(model, html, lines):
    assert html_extraction.main_text(html, model).split("\n") == lines


def test_blocks():
    html = "<p>a&amp;b &lt;c <b>d<br>e</b>\n f<p>g<script>var t='</p>'</script><!-- x --><td title='a>b'>h&nbsp;i<li>j</li>k</x><div/>l<a href=\"x"
    assert [b.text for b in html_blocks.blocks(html)] == ["a&b <c d e f", "g", "h i", "j", "k", "l"]
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("&am")] == ["&am"]
    assert len(html_blocks.blocks("<div><b>" * 20_000 + "x" + "</i>" * 20_000)) == 1


def test_extract_text(spark, crf):
    article = "<article><h1>T</h1><p>" + "Word after word, and more of it. " * 5 + "</p></article>"
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>" + article + "<div class=ad>Buy this now.</div><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", page, "x"), (3, "w", "<article><h1>T</h1>" + f"<p>{LONG}</p>" * 20_000, "x")]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), crf).collect()
    long = next(r for r in got if r.page_id == 3)
    assert long.n_chars == len(long.text) and long.text.count(LONG) == 20_000
    got = [r for r in got if r.page_id != 3]
    want = "T\n" + ("Word after word, and more of it. " * 5).strip()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", want, len(want))] * 2 + [("2", "", 0), ("None", "", 0)])
    assert html_extraction.extract_text(spark.createDataFrame([], "page_id long, url string, html string"), crf).count() == 0


def documents(spark, n=700):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(["one", "two", "three", "four", "five", "six"], int(rng.integers(1, 60))).tolist()
        bad = i % 4 == 0
        if bad:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = ["nasty"] if i % 8 else ["so", "vile"]
        elif i % 4 == 1:
            words.insert(0, "vile")  # harmless without the word before
        rows.append((i, " ".join(words).capitalize() + ".", "en" if i % 3 else "de", 0.5))
        labels.append((i, int(bad)))
    rows += [(None, None, None, 0.5), (9001, "", "en", 0.5), (0, rows[0][1], "en", 0.5)]
    labels += [(3, None), (None, 1), (5, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = documents(spark)
    got = {(r.doc_id, i): r for i, r in enumerate(toxicity.classify(docs, labels).collect())}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got.values() if r.held_out and r.doc_id in truth and r.doc_id is not None]
    assert len(held) > 80 and sum(x == y for x, y in held) / len(held) > 0.93


def test_toxicity_ignores_held_out_labels_and_order(spark):
    docs, labels = documents(spark, 200)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).repartition(5)
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.classify(d, x).collect()) for d, x in ((docs, labels), (docs.repartition(3), flipped)))
    assert a == b


@pytest.mark.parametrize("where", ["toxic = 0", "false"])
def test_toxicity_without_both_labels(spark, where):
    docs, labels = documents(spark, 30)
    assert len({r.score for r in toxicity.classify(docs, labels.where(where)).collect()}) == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def small_network(seed=3):
    """A network with a few known buckets, and two short padded texts."""
    rng = np.random.default_rng(seed)
    model = toxicity.Cnn(
        np.zeros((toxicity.BUCKETS, toxicity.DIM)), [rng.normal(0, 0.5, (k, toxicity.DIM, toxicity.FILTERS)) for k in toxicity.WIDTHS],
        [rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1,
    )
    model.embedding[:40] = rng.normal(0, 1, (40, toxicity.DIM))
    texts = [rng.integers(0, 40, (n, toxicity.PARTS)) for n in (7, 1, 12)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return model, texts, np.concatenate(texts), first


def naive_score(model, text):
    """Every window, word by word; a window may reach into the padding behind the text, which adds nothing."""
    z = model.bias
    for no, k in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -np.inf
            for i in range(len(text)):
                value = model.shifts[no][f]
                for j in range(k):
                    if i + j < len(text):
                        value += sum(model.embedding[part] for part in text[i + j]) @ model.filters[no][j][:, f]
                best = max(best, value)
            z += max(best, toxicity.LEAK * best) * model.out[no * toxicity.FILTERS + f]
    return z


def test_network_equals_a_naive_forward_pass():
    model, texts, ids, first = small_network()
    got = toxicity.raw_scores(model, ids, first)
    assert got == pytest.approx([naive_score(model, t) for t in texts], rel=1e-4)


def test_gradients_equal_numerical_ones():
    model, _, ids, first = small_network(5)
    labels, known = np.array([1, 0, 1]), np.arange(toxicity.BUCKETS) < 40
    padded, begin = toxicity.padded(ids, first)

    def loss():
        pooled, _ = toxicity._forward(model, padded, begin)
        z = np.maximum(pooled, toxicity.LEAK * pooled) @ model.out + model.bias
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    grads, grad_b, rows, grad_e = toxicity.gradients(model, padded, begin, labels, known)

    def numeric(array, at, step=1e-6):
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    rng = np.random.default_rng(1)
    for array, grad in zip([*model.filters, *model.shifts, model.out], grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in array.shape)
            assert grad[at] == pytest.approx(numeric(array, at), abs=1e-6)
    by_row = dict(zip(rows.tolist(), grad_e, strict=True))
    for row in range(40):
        for d in (0, 3, 7):
            assert by_row.get(row, np.zeros(toxicity.DIM))[d] == pytest.approx(numeric(model.embedding, (row, d)), abs=1e-6)
    held, model.bias = model.bias, model.bias + 1e-6
    up, model.bias = loss(), held
    assert grad_b == pytest.approx((up - loss()) / 1e-6, abs=1e-4)


def test_very_long_texts_are_scored_whole(spark):
    docs, labels = documents(spark)
    long = "one two three " * 60_000 + "so vile"
    more = docs.unionByName(spark.createDataFrame([(20_000, long, "en", 0.5), (20_001, "one two three " * 60_000, "en", 0.5)], docs.schema))
    got = {r.doc_id: r.score for r in toxicity.classify(more, labels).where("doc_id >= 20000").collect()}
    assert got[20_000] > 0.5 > got[20_001]

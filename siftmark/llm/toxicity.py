"""Convolutional text classifier for toxicity, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk

#: Hash buckets of words, width of their embeddings, filters of each width in words.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: A word's embedding is that of the whole word plus those of its first bytes, so many of them, so that forms unseen in training still have one.
STEMS = (4, 7)
PARTS = 1 + len(STEMS)
_SALT = tk.constants(len(STEMS), 11)
#: Buckets in fewer training documents keep an embedding of zero, as do those that training never saw.
MIN_SEEN = 8
#: The bounded sample of labelled documents to learn from: so many of each label at most, evenly of its languages, those with the smallest hashes of their doc_id, of at most LONGEST words each and TRAIN_WORDS of either label in all. Their texts are learned from whole, as scores take whole texts.
MAX_EACH, LONGEST, TRAIN_WORDS = 3000, 50_000, 2_000_000
EPOCHS, BATCH, RATE = 8, 32, 0.1
#: What a maximum below 0 counts: were it nothing, texts whose words no filter knows yet would teach none of them.
LEAK = 0.3
#: Spread of the embeddings that training begins with.
START = 0.02
#: Bins of the scores from which thresholds are chosen, and the weight, in documents, that all languages have in the choice for one.
BINS, PRIOR = 1000, 40


@dataclass
class Cnn:
    """Embeddings, one filter bank a width, max pooling over the text, logistic output; calibrated by slope and shift."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # of width k: (k, DIM, FILTERS)
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    _tables: list = field(default_factory=list, repr=False)

    def tables(self) -> list[list[np.ndarray]]:
        """What a word adds to each filter from each place of a window; the last row (padding) adds nothing."""
        if not self._tables:
            for w in self.filters:
                self._tables.append([np.vstack([self.embedding @ w[j], np.zeros((1, FILTERS), np.float32)]).astype(np.float32) for j in range(len(w))])
        return self._tables

    def __getstate__(self):
        return self.__dict__ | {"_tables": []}


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with max(WIDTHS) - 1 paddings after each text, an empty text having one padding as its word; and where each text begins."""
    pad = max(WIDTHS) - 1
    n = np.maximum(np.diff(first), 1)
    begin = np.concatenate([[0], np.cumsum(n + pad)])
    out = np.full((begin[-1], PARTS), BUCKETS, np.int64)
    text = np.repeat(np.arange(len(n)), np.diff(first))
    out[np.arange(len(ids)) - first[text] + begin[text]] = ids
    return out, begin


def _activations(model: Cnn, ids: np.ndarray) -> Iterator[np.ndarray]:
    """For each width the filters' values at every window of the padded words."""
    pad = max(WIDTHS) - 1
    n = len(ids) - pad
    for tables, shift in zip(model.tables(), model.shifts, strict=True):
        total = tables[0][ids[:n, 0]] + shift
        for j in range(len(tables)):
            for part in range(PARTS):
                if j or part:
                    total += tables[j][ids[j : n + j, part]]
        yield total


def _pooled(model: Cnn, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Maxima over each text's windows; a window that begins in the padding is a text's end repeated or weaker, so it is left out."""
    pad = max(WIDTHS) - 1
    edges = np.stack([begin[:-1], begin[1:] - pad], 1).ravel()
    edges = edges[:-1]  # the last text's windows end the array
    return np.hstack([np.maximum.reduceat(a, edges, axis=0)[::2] for a in _activations(model, ids)])


def raw_scores(model: Cnn, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    words, begin = padded(ids, first)
    # summed row by row, so a text's score doesn't hang on its neighbours
    return (_active(_pooled(model, words, begin)).astype(np.float64) * model.out).sum(1) + model.bias


def _active(pooled: np.ndarray) -> np.ndarray:
    return np.maximum(pooled, LEAK * pooled)


def scores(model: Cnn, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    z = model.slope * raw_scores(model, ids, first).astype(np.float64) + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PARTS buckets for each word, of the whole of it and of its first STEMS bytes; and where each text's words begin."""
    starts, ends = tk.runs(tk.ALNUM[data], offsets)
    prefix = tk.sums(data, tk.FOLDED)
    whole = tk.span_hashes(prefix, starts, ends)
    stems = [tk.mix(tk.span_hashes(prefix, starts, np.minimum(starts + n, ends)) ^ salt) for n, salt in zip(STEMS, _SALT, strict=True)]
    return (np.stack([whole, *stems], 1) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.searchsorted(starts, offsets)


def train(texts: list[np.ndarray], labels: np.ndarray, rate_of_ones: float | None = None, seed: int = 7) -> Cnn:
    """A network fitted by gradient steps to texts (arrays of word_ids) and labels (0 or 1), with one text in five kept for calibration.

    rate_of_ones: the share of label 1 where the scores are used, if it is not
    that of the labels given. Without both labels the score is the share of
    label 1.
    """
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    n_filters = FILTERS * len(WIDTHS)
    embedding = rng.normal(0, START, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, (k * DIM) ** -0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    model = Cnn(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(rng.normal(0, 0.3, n_filters)).astype(np.float32), float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        return model
    held = np.arange(len(texts)) % 5 == 4
    learn = np.flatnonzero(~held)
    seen = np.zeros(BUCKETS, np.int64)
    for i in learn:
        words = np.unique(texts[i])
        seen[words[words < BUCKETS]] += 1
    known = seen >= MIN_SEEN
    embedding[~known] = 0
    params = [*filters, *model.shifts, model.out]
    squares = [np.full_like(p, 1e-4) for p in params]
    square_e, square_b = np.full_like(embedding, 1e-3), 1e-4
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(learn), RATE / (1 + epoch)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in batch])])
            ids, begin = padded(np.concatenate([texts[i] for i in batch]), first)
            grads, grad_b, rows, grad_e = gradients(model, ids, begin, labels[batch], known)
            for p, g, s in zip(params, grads, squares, strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
            square_b += grad_b**2
            model.bias -= rate * grad_b / square_b**0.5
            square_e[rows] += grad_e * grad_e
            embedding[rows] -= rate * grad_e / np.sqrt(square_e[rows])
            model._tables = []
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], labels[held])
    if rate_of_ones is not None:
        odds_of = lambda p: np.log(p / (1 - p))
        model.shift += float(odds_of(np.clip(rate_of_ones, 1e-4, 1 - 1e-4)) - odds_of(share))
    return model


def gradients(model: Cnn, ids: np.ndarray, begin: np.ndarray, labels: np.ndarray, known: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss of padded texts: by the filters, shifts and output weights, by the bias, and by rows of the embedding (which rows, and their gradients); only rows that are known have one."""
    pooled, where = _forward(model, ids, begin)
    active = _active(pooled)
    p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.bias, -30, 30)))
    error = ((p - labels) / len(labels)).astype(pooled.dtype)
    back = error[:, None] * model.out[None, :] * np.where(pooled > 0, 1, LEAK).astype(pooled.dtype)
    grads = [np.zeros_like(w) for w in model.filters] + [np.zeros_like(s) for s in model.shifts] + [active.T @ error]
    touched, flows = [], []
    for no, k in enumerate(WIDTHS):
        part = back[:, no * FILTERS : (no + 1) * FILTERS]
        grads[len(WIDTHS) + no] += part.sum(0)
        for j, half in np.ndindex(k, PARTS):
            word = ids[where[no] + j, half]  # texts x filters
            within = np.minimum(word, BUCKETS - 1)
            real = (word < BUCKETS) & known[within]
            grads[no][j] += np.einsum("tf,tfd->df", part, model.embedding[within] * real[..., None])
            touched.append(word[real])
            flows.append((part[..., None] * model.filters[no][j].T[None])[real])
    rows, back_to = np.unique(np.concatenate(touched), return_inverse=True)
    grad_e = np.zeros((len(rows), DIM), pooled.dtype)
    np.add.at(grad_e, back_to, np.concatenate(flows))
    return grads, float(error.sum()), rows, grad_e


def _forward(model: Cnn, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima, and the windows they come from (texts x filters of each width), from the words' embeddings at hand."""
    pad, pooled, where = max(WIDTHS) - 1, [], []
    real = (ids < BUCKETS)[..., None]
    e = (model.embedding[np.minimum(ids, BUCKETS - 1)] * real).sum(1)
    n = len(ids) - pad
    for w, shift in zip(model.filters, model.shifts, strict=True):
        a = e[:n] @ w[0] + shift
        for j in range(1, len(w)):
            a += e[j : n + j] @ w[j]
        best = np.stack([a[b : c - pad].argmax(0) + b for b, c in zip(begin[:-1], begin[1:], strict=True)])
        where.append(best)
        pooled.append(np.take_along_axis(a, best, 0))
    return np.hstack(pooled), where


def _calibrate(model: Cnn, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """Slope and shift by logistic regression (Newton) on the texts kept back, drawn towards slope 1 and shift 0."""
    if not len(labels):
        return
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = raw_scores(model, np.concatenate(texts), first).astype(np.float64)
    a = np.stack([x, np.ones_like(x)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        slope = a.T @ (p - labels) + 0.1 * (theta - [1, 0])
        bend = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(bend, slope), -2, 2)
    model.slope, model.shift = float(max(theta[0], 0.05)), float(theta[1])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether labels of the document are kept from learning: crc32 of the doc_id as text, modulo 5, is 0; a null doc_id is."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def _fifth(no: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == no


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, chooses): one label a document (the largest of repeated rows), without nulls and held-out documents; one in four of them is kept from training and chooses thresholds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("chooses", _fifth(1))


def fit(documents: DataFrame, labels: DataFrame, max_each: int = MAX_EACH) -> Cnn:
    """A network from a bounded sample of the documents with a label: see MAX_EACH, LONGEST and TRAIN_WORDS."""
    known = tk.durable(learnable(labels).where("NOT chooses"))
    count = dict(known.groupBy("toxic").count().collect())
    # lang chooses rows, it enters no score; each language's first, then each one's second, and so on
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    langs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    nth = F.row_number().over(Window.partitionBy("toxic", "lang").orderBy(*order))
    ranked = known.join(langs, "doc_id").withColumn("nth", nth).where(F.col("nth") <= 2 * max_each)
    # twice as many as are taken, as some may be too long; at most 4 * max_each ids, small enough to broadcast
    some = [ranked.where(F.col("toxic") == label).orderBy("nth", *order).limit(2 * max_each).select("doc_id", "toxic", "nth") for label in (0, 1)]
    candidates = tk.durable(some[0].union(some[1]))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tk.text_chunks(batch.column(3)):
                n = np.diff(word_ids(data, offsets)[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(n.astype(np.int64))], names=["doc_id", "toxic", "nth", "n"])

    # lengths decide what is taken, before any words move; over 2 * max_each documents a label
    sized = texts.join(F.broadcast(candidates), "doc_id").select("doc_id", "toxic", "nth", "text").mapInArrow(tk.lean(lengths), "doc_id long, toxic int, nth int, n long")
    sized = sized.where(F.col("n") <= LONGEST).groupBy("doc_id", "toxic", "nth").agg(F.max("n").alias("n"))
    upto = Window.partitionBy("toxic").orderBy("nth", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sized.withColumns({"taken": F.count(F.lit(1)).over(upto), "upto": F.sum("n").over(upto)}).where((F.col("taken") <= max_each) & (F.col("upto") <= TRAIN_WORDS))
    chosen = tk.durable(fits.select("doc_id", "toxic"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tk.text_chunks(batch.column(2)):
                ids, first = word_ids(data, offsets)
                packed = [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "words"])

    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(tk.lean(words), "doc_id long, toxic int, words binary")
    taken = found.groupBy("doc_id", "toxic").agg(F.max("words").alias("words")).collect()  # of rows with one doc_id, one
    taken.sort(key=lambda r: (tk.mix(np.array([r.doc_id], np.int64).view(np.uint64))[0], bytes(r.words)))  # the same order whatever the partitions
    texts = [np.frombuffer(bytes(r.words), "<u4").astype(np.int64).reshape(-1, PARTS) for r in taken]
    return train([t if len(t) else np.full((1, PARTS), BUCKETS) for t in texts], np.array([r.toxic for r in taken], np.int64), count.get(1, 0) / max(1, sum(count.values())))


def score_documents(documents: DataFrame, model: Cnn) -> DataFrame:
    """doc_id, lang, score of every document, from its whole text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tk.text_chunks(batch.column(2), 1 << 20):
                kept = [batch.column(c).slice(i, j - i) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores(shared.value, *word_ids(data, offsets)), pa.float64())], names=["doc_id", "lang", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(tk.lean(go), "doc_id long, lang string, score double")


def language_thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, threshold): from which score F1 is largest over the labelled documents of a language that chose nothing else.

    Neither the training nor held_out() knows these documents. All languages
    together count as PRIOR documents in each one's choice, so that few labels
    don't make a threshold of their own. The threshold lies midway between the
    least score above it and the next below; of equal choices the highest.
    """
    known = tk.durable(scored.join(learnable(labels).where("chooses"), "doc_id").select("lang", F.floor(F.col("score") * BINS).alias("bin"), "toxic"))
    bins = known.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    down = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("bin"))  # noqa: E731  over at most BINS + 1 rows of a language, or of all
    upto = lambda *keys: down(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lambda df, prefix, *keys: df.withColumns({f"{prefix}{c}": F.sum(c).over(upto(*keys)) for c in ("n", "hits")} | {f"{prefix}all_{c}": F.sum(c).over(Window.partitionBy(*keys)) for c in ("n", "hits")})
    every = sums(bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "p_").drop("n", "hits")
    own = sums(bins, "o_", "lang").withColumn("below", F.coalesce(F.lead("bin").over(down("lang")), F.lit(-1)))
    both = own.join(every, "bin").withColumn("w", F.lit(float(PRIOR)) / F.col("p_all_n"))
    of = lambda c: F.col(f"o_{c}") + F.col("w") * F.col(f"p_{c}")
    best = both.select("lang", "bin", F.round(2 * of("hits") / (of("n") + of("all_hits")), 9).alias("f1"), ((F.col("bin") + F.col("below") + 1) / 2 / BINS).alias("cut"))
    return best.groupBy("lang").agg(F.max_by("cut", F.struct("f1", "bin")).alias("threshold"))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), lang, threshold (its language's; 0.5 without labels), toxic (score >= threshold).

    Null and empty texts have the score of a text without words; repeated rows
    each get theirs; null languages are a language. Without labels of both
    kinds the score is one number for all.
    """
    scored = tk.scanned(score_documents(documents, fit(documents, labels)))
    limits = tk.durable(language_thresholds(scored, labels)).withColumnRenamed("lang", "of")
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return joined.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang", "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(tk.read(spark, sf_dir, "documents"), tk.read(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op4_toxicity_cnn": op4_toxicity_cnn}

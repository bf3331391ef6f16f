"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .html_blocks import NAMED, Block, blocks
from .html_training import MARK, labelled_pages
from . import textkit as tk
from .textkit import read

#: Labelled pages to train on, rounds over them, step and penalty.
PAGES, EPOCHS, RATE, PENALTY = 500, 4, 0.3, 1e-4


def text_features(block: Block, before: int, after: int) -> list[str]:
    """Features of a block's text and place; before, after: blocks of the page on either side."""
    text = block.text
    words = text.count(" ") + 1
    linked = min(4, 4 * block.linked // max(1, len(text)))
    size = min(7, words.bit_length())
    named = NAMED in block.frame.names
    return [
        f"own:{block.own}",
        f"size:{size}",
        f"linked:{linked}",
        f"size:{size} own:{block.own}",
        f"size:{size} named:{named}",
        f"linked:{linked} named:{named}",
        f"stop:{text[-1] in '.!?:;…”\"'}",
        f"commas:{min(3, text.count(','))}",
        f"mark:{any(c in text for c in '©®™')}",
        f"first:{before < 2}",
        f"last:{after < 2}",
    ]


@dataclass
class Crf:
    """Two labels (1: main text). weights: what a feature adds to label 1; step[y, z]: from label y to z. Either label may begin a page: that has no weight of its own."""

    weights: dict[str, float]
    step: np.ndarray

    def emissions(self, page: list[Block]) -> np.ndarray:
        weights, above, out = self.weights, {}, np.zeros(len(page))
        for i, block in enumerate(page):
            total = 0.0
            names = block.frame.names
            if (got := above.get(id(names))) is None:
                got = above[id(names)] = sum(weights.get(x, 0.0) for x in sorted(names))
            total += got
            for x in text_features(block, i, len(page) - 1 - i):
                total += weights.get(x, 0.0)
            out[i] = total
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi; of equal ones label 0."""
        if not page:
            return []
        (a, b), (c, d) = self.step.tolist()
        emissions = self.emissions(page).tolist()
        zero, one = 0.0, emissions[0]
        back = []
        for e in emissions[1:]:
            from_zero, from_one = zero + b, one + d
            stay, fall = zero + a, one + c
            back.append((int(fall > stay), int(from_one > from_zero)))
            zero, one = max(stay, fall), max(from_zero, from_one) + e
        labels = [int(one > zero)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def _marginals(emissions: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of label 1, and expected counts of label pairs, by forward and backward sums in logarithms."""
    n = len(emissions)
    score = np.stack([np.zeros(n), emissions], 1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = score[0]
    for i in range(1, n):
        forward[i] = np.logaddexp(forward[i - 1, 0] + step[0], forward[i - 1, 1] + step[1]) + score[i]
    for i in range(n - 2, -1, -1):
        x = score[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(step[:, 0] + x[0], step[:, 1] + x[1])
    total = np.logaddexp(*forward[-1])
    one = np.exp(forward[:, 1] + backward[:, 1] - total)
    pairs = np.zeros((2, 2))
    if n > 1:
        joint = forward[:-1, :, None] + step[None] + (score[1:] + backward[1:])[:, None, :] - total
        pairs = np.exp(joint).sum(0)
    return one, pairs


def train(pages: list[str]) -> Crf:
    """Weights fitted by AdaGrad to the conditional likelihood of labelled pages (article blocks begin with MARK)."""
    data = []
    for html in pages:
        page = blocks(html)
        gold = np.array([MARK in b.text for b in page], float)
        for b in page:
            b.text = b.text.replace(MARK, "")
        page_features = [[*b.frame.names, *text_features(b, i, len(page) - 1 - i)] for i, b in enumerate(page)]
        data.append((gold, page_features))
    index = {x: i for i, x in enumerate(sorted({x for _, page in data for f in page for x in f}))}
    w, step = np.zeros(len(index)), np.zeros((2, 2))
    squares = [np.full_like(p, 1e-2) for p in (w, step)]
    coded = [(gold, np.array([index[x] for f in page for x in f]), np.array([len(f) for f in page])) for gold, page in data if page]
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(coded)):
            gold, features, counts = coded[k]
            one, pairs = _marginals(np.add.reduceat(w[features], np.cumsum(counts) - counts), step)
            grad_w, real = np.bincount(features, np.repeat(one - gold, counts), len(w)), np.zeros((2, 2))
            y = gold.astype(int)
            np.add.at(real, (y[:-1], y[1:]), 1)
            for p, g, s in zip((w, step), (grad_w + PENALTY * w, pairs - real), squares, strict=True):
                s += g * g
                p -= RATE * g / np.sqrt(s)
    return Crf({x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-6}, step)


def main_text(html: str | None, model: Crf) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, y in zip(page, model.decode(page), strict=True) if y)


def extract_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Without a model, one is trained on labelled_pages(PAGES). A null or empty
    page has an empty text, a page cut off somewhere the text up to there;
    repeated rows each get theirs; other columns are not read.
    """
    model = train(list(labelled_pages(PAGES))) if model is None else model

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(html.as_py(), model) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "html").mapInArrow(tk.lean(go), "page_id long, url string, text string, n_chars long")


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op7_html_crf": op7_html_crf}

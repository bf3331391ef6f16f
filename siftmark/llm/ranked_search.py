"""Ranked lexical search: MaxScore over index segments, with bounds of term pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.durable import new_folder
from . import textkit as tk

TOP = 10
#: Fixed values of the score.
_UNIT, _TF, _M, _FLAT, _SLOPE = 1_000_000_000, 1000, 8, 100 - 90, 90
#: Terms of the items that one pass over the index takes: they are broadcast, so their number is bounded. More items take more passes.
BLOCK_TERMS = 1 << 18
#: A segment of the index ends at so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 1 << 21
#: A null doc_id within a segment: it comes after all others.
_NULL = (1 << 63) - 1

SEGMENT = "n_docs long, n_terms long, docs binary, lengths binary, terms binary, first binary, at binary, tf binary"
BOUNDED = "docs binary, terms binary, first binary, at binary, impacts binary, pairs binary, joint binary"
_BEST = "no int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct terms of each item; rows of one item_id are one item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    one = items.select("item_id", F.explode(terms).alias("term")).distinct()
    return one.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


@dataclass
class Block:
    """Items of one pass: their ids, the hashes of all their terms (sorted), and the places in these of each item's terms."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        words = sorted({t for _, terms in rows for t in terms})
        hashed = np.array([tk.words_list(w, tk.ALNUM, tk.EXACT)[0] for w in words], np.uint64)
        place = dict(zip(words, np.argsort(np.argsort(hashed)).tolist(), strict=True))
        return cls([i for i, _ in rows], np.sort(hashed), [np.array(sorted(place[t] for t in terms), np.int64) for _, terms in rows])


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items, so many at once that a block has less than BLOCK_TERMS terms beside those of its last item; the driver holds one block."""
    rows, size = [], 0
    for item_id, terms in tk.durable(item_terms(items)).toLocalIterator():
        rows.append((item_id, terms))
        size += len(terms)
        if size >= BLOCK_TERMS:
            yield Block.of(rows)
            rows, size = [], 0
    if rows:
        yield Block.of(rows)


# The index.


def segments(documents: DataFrame, hashes: np.ndarray) -> DataFrame:
    """SEGMENT: inverted lists of so many documents, for the terms of these hashes (sorted).

    docs and lengths are those of the documents that hold any of them; list i, of the term terms[i], is
    at[first[i] : first[i + 1]] (places in docs, rising) with the occurrences tf. n_docs and n_terms count all documents
    with a term, and all their terms.
    """
    shared = documents.sparkSession.sparkContext.broadcast(hashes)

    def flush(parts: list[tuple], n_docs: int, n_terms: int) -> pa.RecordBatch:
        docs, lengths, at, term, tf = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 5
        order = np.lexsort((at, term))
        term = term[order]
        new = np.flatnonzero(np.diff(term, prepend=-1))
        data = (docs, lengths, term[new].astype(np.int32), np.append(new, len(term)), at[order].astype(np.int32), tf[order].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["n_docs", "n_terms", "docs", "lengths", "terms", "first", "at", "tf"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        parts: list[tuple] = []
        held = postings = n_docs = n_terms = 0
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL).to_numpy()
            for i, j, data, offsets in tk.text_chunks(batch.column(1)):
                words, _, _, first = tk.words_of(data, offsets, tk.ALNUM, tk.FOLDED)
                lengths = np.diff(first)
                n_docs += int(np.count_nonzero(lengths))
                n_terms += len(words)
                place = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
                hit = np.flatnonzero(wanted[place] == words)
                key, tf = np.unique(np.repeat(np.arange(j - i), lengths)[hit] * len(wanted) + place[hit], return_counts=True)
                local, term = key // len(wanted), key % len(wanted)
                docs, at = np.unique(local, return_inverse=True)
                parts.append((ids[i:j][docs], lengths[docs], at + held, term, tf))
                held += len(docs)
                postings += len(key)
                if held >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield flush(parts, n_docs, n_terms)
                    parts, held, postings, n_docs, n_terms = [], 0, 0, 0, 0
        if n_docs:
            yield flush(parts, n_docs, n_terms)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tk.lean(go), SEGMENT)


def _numbers(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[0].as_buffer(), kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def document_counts(index: DataFrame, n_terms: int) -> DataFrame:
    """term, df: in how many documents each term is, counted by list length in every task first."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for row in _rows(batches):
            df[_numbers(row, "terms", np.int32)] += np.diff(_numbers(row, "first", np.int64))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(df[term])], names=["term", "df"])

    return index.select("terms", "first").mapInArrow(go, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def term_weights(n_terms: int, n_docs: int, counts: list[tuple[int, int]]) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))); terms that no document holds weigh nothing."""
    out = np.zeros(n_terms, np.int64)
    for term, df in counts:
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


def neighbour_pairs(ordered: list[np.ndarray]) -> np.ndarray:
    """Pairs of terms (rows of two) that follow each other in an item's order: those whose intersections are kept."""
    pairs = [np.stack([t[:-1], t[1:]], 1) for t in ordered if len(t) > 1]
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)


def bounded_segments(index: DataFrame, n_docs: int, total: int, weights, pairs) -> DataFrame:
    """BOUNDED: segments with the impact of every posting, and for every pair of terms with documents in common the number of the pair and its joint maximum impact."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, couples = weights.value, pairs.value
        starts = np.searchsorted(couples[:, 0], np.arange(len(w) + 1))
        for row in _rows(batches):
            terms, first, at, tf = _numbers(row, "terms", np.int32), _numbers(row, "first", np.int64), _numbers(row, "at", np.int32), _numbers(row, "tf", np.int32).astype(np.int64)
            lengths = _numbers(row, "lengths", np.int64)
            m = _FLAT + _SLOPE * lengths * n_docs // total
            impacts = np.repeat(w[terms], np.diff(first)) * (_UNIT * tf // (_TF * tf + _M * m[at]))
            place = np.full(len(w), -1)
            place[terms] = np.arange(len(terms))
            number, joint = [], []
            one = np.zeros(len(lengths), np.int64)
            for a, t in enumerate(terms.tolist()):
                partners = couples[starts[t] : starts[t + 1], 1]
                if len(partners):
                    mine = at[first[a] : first[a + 1]]
                    one[mine] = impacts[first[a] : first[a + 1]]
                    for k, b in zip(range(starts[t], starts[t + 1]), place[partners].tolist(), strict=True):
                        if b >= 0:
                            other = one[at[first[b] : first[b + 1]]]
                            both = other > 0
                            if both.any():
                                number.append(k)
                                joint.append(int((other + impacts[first[b] : first[b + 1]])[both].max()))
                    one[mine] = 0
            data = [np.array(number, np.int32), np.array(joint, np.int64)]
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("docs", "terms", "first", "at")), *(pa.array([x.tobytes()], pa.binary()) for x in (impacts, *data))], names=["docs", "terms", "first", "at", "impacts", "pairs", "joint"])

    return index.mapInArrow(tk.lean(go), BOUNDED)


# The search.


class _Segment:
    """One row of BOUNDED, and what queries need of it."""

    def __init__(self, row: pa.RecordBatch, pairs: np.ndarray, n_terms: int):
        self.docs, self.first, self.at, self.impacts = _numbers(row, "docs", np.int64), _numbers(row, "first", np.int64), _numbers(row, "at", np.int32), _numbers(row, "impacts", np.int64)
        terms = _numbers(row, "terms", np.int32)
        self.place = np.full(n_terms, -1)
        self.place[terms] = np.arange(len(terms))
        self.most = np.maximum.reduceat(self.impacts, self.first[:-1]) if len(terms) else np.empty(0, np.int64)
        number, joint = _numbers(row, "pairs", np.int32), _numbers(row, "joint", np.int64)
        self.joint = dict(zip(map(tuple, pairs[number].tolist()), joint.tolist(), strict=True))

    def lists(self, ordered: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Of an item's terms that the segment holds, in the item's order: the places of their lists, their maximum impacts, and the joint maximum of each with the next (-1: unknown, as they aren't a kept pair)."""
        here = self.place[ordered]
        there = np.flatnonzero(here >= 0)
        most = self.most[here[there]].tolist()
        names, joint = ordered[there].tolist(), []
        for k in range(len(names) - 1):
            if there[k + 1] == there[k] + 1:  # a kept pair; if it isn't in the list, no document holds both
                joint.append(max(self.joint.get((names[k], names[k + 1]), 0), most[k], most[k + 1]))
            else:
                joint.append(-1)
        return here[there].tolist(), most, joint


def suffix_bounds(most: list[int], joint: list[int]) -> list[int]:
    """The most that a document can score with the terms from k on, for every k: each term's own maximum, or a pair's joint one, whichever choice of pairs gives least."""
    bounds = [0] * (len(most) + 1)
    for k in range(len(most) - 1, -1, -1):
        bounds[k] = bounds[k + 1] + most[k]
        if k < len(joint) and joint[k] >= 0:
            bounds[k] = min(bounds[k], bounds[k + 2] + joint[k])
    return bounds


def _search(segment: _Segment, ordered: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and score of the segment's best TOP documents, of those with a score of at least least (1 or more)."""
    lists, most, joint = segment.lists(ordered)
    bounds = suffix_bounds(most, joint)
    score = np.zeros(len(segment.docs), np.int64)
    k = 0
    while k < len(lists) and bounds[k] >= least:  # documents that none of the terms before holds can still come in
        a, b = segment.first[lists[k]], segment.first[lists[k] + 1]
        score[segment.at[a:b]] += segment.impacts[a:b]
        k += 1
        if k & (k - 1) == 0 and len(score) >= TOP:
            least = max(least, int(np.partition(score, -TOP)[-TOP]))
    found = np.flatnonzero((score > 0) & (score + bounds[k] >= least))
    for i in range(k, len(lists)):  # only for those that are left
        a, b = segment.first[lists[i]], segment.first[lists[i] + 1]
        at = segment.at[a:b]
        to = np.minimum(np.searchsorted(at, found), b - a - 1)
        total = score[found] + np.where(at[to] == found, segment.impacts[a:b][to], 0)
        score[found] = total
        found = found[total + bounds[i + 1] >= least]
    total = score[found]
    if len(found) > TOP:
        best = total >= np.partition(total, -TOP)[-TOP]
        found, total = found[best], total[best]
    best = np.lexsort((segment.docs[found], -total))[:TOP]
    return segment.docs[found[best]], total[best]


def _top_rows(rows: DataFrame) -> DataFrame:
    window = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= TOP)


def _first_thresholds(index: DataFrame, n_items: int, ordered, pairs, n_terms: int) -> np.ndarray:
    """A score that TOP documents at least reach, by item: segments share no document, and each has one with its largest joint (or single) impact."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((n_items, TOP), np.int64)
        for row in _rows(batches):
            segment = _Segment(row, pairs.value, n_terms)
            for no, terms in enumerate(ordered.value):
                _, most, joint = segment.lists(terms)
                one = max([0, *most, *joint])
                if one > best[no, 0]:
                    best[no, 0] = one
                    best[no].sort()
        no, column = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(no.astype(np.int32)), pa.array([None] * len(no), pa.int64()), pa.array(best[no, column])], names=["no", "doc_id", "score"])

    out = np.ones(n_items, np.int64)
    for no, score in _top_rows(index.mapInArrow(tk.lean(go), _BEST)).where(F.col("rank") == TOP).select("no", "score").collect():  # a row an item of the block
        out[no] = max(1, score)
    return out


def _search_block(documents: DataFrame, block: Block) -> DataFrame:
    spark, n_terms, n_items = documents.sparkSession, len(block.hashes), len(block.ids)
    send = spark.sparkContext.broadcast
    raw = tk.scanned(segments(documents, block.hashes))
    n_docs, total = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], _BEST).select("no", F.lit(0).alias("rank"), "doc_id", "score")
    w = term_weights(n_terms, n_docs, document_counts(raw, n_terms).collect())
    in_order = [t[np.lexsort((t, -w[t]))] for t in block.terms]
    couples = neighbour_pairs(in_order)
    weights, ordered, pairs = send(w), send(in_order), send(couples)
    index = tk.scanned(bounded_segments(raw, n_docs, total, weights, pairs))
    weights.destroy()
    least = send(_first_thresholds(index, n_items, ordered, pairs, n_terms))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2] * n_items
        bar = least.value.copy()
        for row in _rows(batches):
            segment = _Segment(row, pairs.value, n_terms)
            for no, terms in enumerate(ordered.value):
                docs, scores = _search(segment, terms, int(bar[no]))
                if len(docs):
                    docs, scores = np.concatenate([have[no][0], docs]), np.concatenate([have[no][1], scores])
                    best = np.lexsort((docs, -scores))[:TOP]
                    have[no] = docs[best], scores[best]
                    if len(best) == TOP:
                        bar[no] = max(bar[no], int(scores[best[-1]]))
        no = np.repeat(np.arange(n_items, dtype=np.int32), [len(d) for d, _ in have])
        docs, scores = (np.concatenate([x[i] for x in have]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(docs, mask=docs == _NULL), pa.array(scores)], names=["no", "doc_id", "score"])

    return _top_rows(index.mapInArrow(tk.lean(go), _BEST)).select("no", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents with the highest scores above 0 for every item.

    Terms are `[0-9a-z]` and all beyond ASCII, of whole texts with A-Z lower-cased; they are named by 64-bit hashes. The
    index is made of segments: each holds inverted lists of its documents for the items' terms, the maximum impact of
    each list, and the joint maximum impacts of the pairs of terms that an item has next to each other by weight. A
    search goes through an item's lists from the heaviest term on until the bound of those that are left, in which a
    pair counts with its joint maximum, is below the score that TOP documents reach; from then on only documents found
    so far get more, and those that can't reach that score are left out. So no document of the first TOP is lost.

    Items come in blocks of BLOCK_TERMS terms, each a pass over the documents; the driver holds one block. Null texts
    have no terms; items without terms, and those that no document matches, have no rows. Rows of one item_id are one
    item (null too); rows of one doc_id count as documents of their own, and a null doc_id comes after all others of its
    score. Other columns are not read.
    """
    spark, parts = documents.sparkSession, []
    item_type = items.schema["item_id"].dataType
    for block in _blocks(items):
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"no int, item_id {item_type.simpleString()}")
        parts.append(_search_block(documents, block).join(F.broadcast(ids), "no").select("item_id", "rank", "doc_id", "score"))
        if len(parts) > 1:  # so that no index but the last block's is needed any more
            for i in range(max(0, len(parts) - 2), len(parts)):
                folder = new_folder(spark, "search")
                parts[i].write.parquet(folder)
                parts[i] = spark.read.parquet(folder)
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_pair_bound_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(tk.read(spark, sf_dir, "documents"), tk.read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op13_pair_bound_maxscore": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT row, doc_id, len(ts)::BIGINT AS n, term, count(*) AS tf FROM (SELECT row, doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
scored AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * ({_FLAT} + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""
}
QUERIES = {"op13_pair_bound_maxscore": op13_pair_bound_maxscore}

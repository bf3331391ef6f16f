"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .bitmaps import hash_bitmap, probe

#: An overlap is a window of so many aligned words of which at least LEAST are equal.
SPAN, LEAST = 12, 10
#: Fixed masks over a window, of two blocks of three words each: whichever two words differ, two of the four blocks are whole, so one mask at least ignores both.
BLOCK = 3
MASKS = tuple((i, j) for i in range(0, SPAN, BLOCK) for j in range(i + BLOCK, SPAN, BLOCK))
_SALT = tk.constants(2 * len(MASKS), 5)
_SEEDS = pa.list_(pa.struct([("pos", pa.int64()), ("seed", pa.int64())]))
RUNS = "doc_id long, run long, words array<long>, seeds array<struct<pos: long, seed: long>>"


def seeds_of(words: np.ndarray) -> list[np.ndarray]:
    """For each mask the hashes of all windows, by the window's first word."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return [np.empty(0, np.uint64)] * len(MASKS)
    block = tk.gram_hashes(words, BLOCK)
    return [tk.mix(block[i : i + n] * _SALT[2 * m] + block[j : j + n] * _SALT[2 * m + 1]) for m, (i, j) in enumerate(MASKS)]


def _seed_runs(ids: list, data: np.ndarray, offsets: np.ndarray, bits: np.ndarray | None) -> list[tuple]:
    """(id, first word, word hashes, [(window's first word, seed)]) of stretches whose windows have a seed in the bitmap (None: all)."""
    words, _, _, first = tk.words_of(data, offsets, tk.ALNUM, tk.FOLDED)
    pos, seed = [], []
    for hashes in seeds_of(words):
        at = np.arange(len(hashes)) if bits is None else np.flatnonzero(probe(bits, hashes))
        pos.append(at)
        seed.append(hashes[at])
    pos, seed = np.concatenate(pos), np.concatenate(seed)
    order = np.argsort(pos, kind="stable")
    pos, seed = pos[order], seed[order]
    text = np.searchsorted(first, pos, "right") - 1
    inside = pos + SPAN <= first[text + 1]
    pos, seed, text = pos[inside], seed[inside].view(np.int64), text[inside]
    if not len(pos):
        return []
    new = np.flatnonzero((np.diff(text) != 0) | (np.diff(pos) > SPAN)) + 1
    out = []
    for a, b in zip([0, *new], [*new, len(pos)], strict=True):
        begin = int(first[text[a]])
        start = int(pos[a])
        out.append((ids[text[a]], start - begin, words[start : int(pos[b - 1]) + SPAN].view(np.int64), [{"pos": int(p) - begin, "seed": int(s)} for p, s in zip(pos[a:b], seed[a:b], strict=True)]))
    return out


def seed_runs(texts: DataFrame, bitmap=None) -> DataFrame:
    """RUNS of a frame (id, text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in tk.text_chunks(batch.column(1)):
                rows = _seed_runs(ids[i:j], data, offsets, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], _SEEDS)],
                    names=["doc_id", "run", "words", "seeds"],
                )

    return texts.mapInArrow(tk.lean(go), RUNS)


def overlap_starts(run: np.ndarray, item: np.ndarray, shift: int) -> np.ndarray:
    """First words (in the run) of the windows that overlap, where word i of the run lies on word i - shift of the item."""
    low, high = max(0, shift), min(len(run), len(item) + shift)
    if high - low < SPAN:
        return np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(run[low:high] == item[low - shift : high - shift])])
    return np.flatnonzero(total[SPAN:] - total[:-SPAN] >= LEAST) + low


def contaminated_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, doc_start, doc_end: documents with a window of 12 words of which 10 or more equal those of a benchmark item in their places, or with all words of an item of fewer than 12 in a row.

    Words are `[0-9a-z]` and all beyond ASCII, of texts with A-Z lower-cased.
    Every document's windows are hashed under all masks; those that a bitmap
    of the benchmark's hashes lets through are joined with them in Spark, and
    the aligned words around each hit are compared. The masks lose no such
    window. Items with equal words count as the one with the smallest item_id, null
    if they have none; items without words find nothing. doc_start and doc_end are word numbers,
    n_windows the number of distinct windows, or of places of a short item.
    Null texts are empty, rows without doc_id are one document, repeated rows
    count once; other columns are not read.
    """
    short = tk.durable(_short_items(benchmark))
    long = _long_passages(documents, benchmark)
    return long if short.isEmpty() else long.unionByName(_whole_items(documents, short))


def _long_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    items = seed_runs(benchmark.select(F.col("item_id").cast("long"), "text"))
    items = items.groupBy("words").agg(F.min("doc_id").alias("item_id"), F.first("seeds").alias("seeds"))
    items = tk.durable(items.withColumn("item_no", F.monotonically_increasing_id()))  # kept, so the numbers stay; an item_id may be null
    item_seeds = items.select("item_no", F.explode("seeds").alias("s")).select("item_no", F.col("s.seed").alias("seed"), F.col("s.pos").alias("item_pos"))
    bitmap = spark.sparkContext.broadcast(hash_bitmap(item_seeds, "seed"))
    runs = tk.scanned(seed_runs(documents.select(F.col("doc_id").cast("long"), "text"), bitmap))
    bitmap.destroy()
    hits = (
        runs.select("doc_id", "run", F.explode("seeds").alias("s"))
        .select("doc_id", "run", F.col("s.seed").alias("seed"), F.col("s.pos").alias("pos"))
        .join(item_seeds, "seed")
        .select("doc_id", "run", "item_no", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .distinct()
    )
    aligned = (
        hits.join(items.select("item_no", F.col("words").alias("item")), "item_no")
        .alias("h")
        .join(runs.select("doc_id", "run", "words").alias("r"), F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.run") == F.col("r.run")))
        .select("h.doc_id", "h.run", "item_no", "diagonal", "words", "item")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, run, item_no, diagonal = (batch.column(c).to_pylist() for c in range(4))
            rows: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                words, item = batch.column(4)[i].values.to_numpy(), batch.column(5)[i].values.to_numpy()
                at = overlap_starts(words, item, diagonal[i] - run[i])
                rows[0].extend([doc[i]] * len(at))
                rows[1].extend([item_no[i]] * len(at))
                rows[2].extend((at + run[i]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "item_no", "pos"])

    windows = (
        aligned.mapInArrow(tk.lean(verify), "doc_id long, item_no long, pos long")
        .distinct()
        .groupBy("doc_id", "item_no")
        .agg(F.count(F.lit(1)).alias("n_windows"), F.min("pos").alias("doc_start"), (F.max("pos") + SPAN).alias("doc_end"))
    )
    return windows.join(items.select("item_no", "item_id"), "item_no").select("doc_id", "item_id", "n_windows", "doc_start", "doc_end")


def _short_items(benchmark: DataFrame) -> DataFrame:
    """words, item_id, n, seed of the items of fewer than SPAN words; the seed is one gram hash of all of them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, data, offsets in tk.text_chunks(batch.column(1)):
                words, _, _, first = tk.words_of(data, offsets, tk.ALNUM, tk.FOLDED)
                short = [(ids[i + k], words[a:b]) for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if 0 < b - a < SPAN]
                seeds = [int(tk.gram_hashes(w, len(w)).view(np.int64)[0]) for _, w in short]
                columns = [pa.array([x for x, _ in short], pa.int64()), pa.array([len(w) for _, w in short], pa.int64()), pa.array(seeds, pa.int64()), pa.array([w.view(np.int64) for _, w in short], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "n", "seed", "words"])

    rows = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(tk.lean(go), "item_id long, n long, seed long, words array<long>")
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n"), F.first("seed").alias("seed"))


def _whole_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """contaminated_passages() of short items (kept): texts go through the same bitmap and the same join on hash, and the words decide."""
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # fewer than SPAN
    bitmap = documents.sparkSession.sparkContext.broadcast(hash_bitmap(items, "seed"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, data, offsets in tk.text_chunks(batch.column(1)):
                words, _, _, first = tk.words_of(data, offsets, tk.ALNUM, tk.FOLDED)
                found: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
                for n in lengths:
                    hashes = tk.gram_hashes(words, n)
                    at = np.flatnonzero(probe(bits, hashes))
                    text = np.searchsorted(first, at, "right") - 1
                    inside = at + n <= first[text + 1]
                    for a, t in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
                        found.setdefault((t, words[a : a + n].tobytes()), (int(hashes[a : a + 1].view(np.int64)[0]), []))[1].append(a - int(first[t]))
                columns = [pa.array([ids[i + t] for t, _ in found], pa.int64()), pa.array([s for s, _ in found.values()], pa.int64()), pa.array([np.frombuffer(w, np.int64) for _, w in found], pa.list_(pa.int64())), pa.array([at for _, at in found.values()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "seed", "words", "at"])

    held = tk.scanned(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tk.lean(go), "doc_id long, seed long, words array<long>, at array<long>"))
    bitmap.destroy()
    places = held.join(items, ["seed", "words"]).select("doc_id", "item_id", "n", F.explode("at").alias("pos")).distinct()
    return places.groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("n_windows"), F.min("pos").alias("doc_start"), (F.max("pos") + F.first("n")).alias("doc_end")).drop("n")


def contaminated_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id of the documents with a passage of any item, whatever its item_id."""
    items = benchmark.select(F.xxhash64("text").alias("item_id"), "text")
    return contaminated_passages(documents, items).select("doc_id").distinct()


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(tk.read(spark, sf_dir, "documents"), tk.read(spark, sf_dir, "benchmark"))


def _words_sql(table: str, key: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""SELECT {key}, ws, unnest(ws) AS w, unnest(range(len(ws))) AS p, len(ws) AS n
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table})"""


SQL = {
    "op1_benchmark_decontamination": f"""
WITH items AS MATERIALIZED (SELECT min(item_id) AS item_id, row_number() OVER () AS item_no, ws, len(ws) AS n FROM (SELECT item_id, ws FROM ({_words_sql('benchmark', 'item_id')}) WHERE p = 0) GROUP BY ws),
b AS (SELECT item_no, ws, unnest(ws) AS w, unnest(range(n)) AS p, n FROM items),
d AS ({_words_sql('documents', 'doc_id')}),
m AS (SELECT doc_id, item_no, d.p AS p, d.p - b.p AS diagonal, least(d.n, b.n + d.p - b.p) AS stop FROM d JOIN b USING (w)),
dense AS (SELECT doc_id, item_no, diagonal FROM m GROUP BY ALL HAVING count(*) >= {LEAST}),
s AS (SELECT doc_id, item_no, diagonal, stop, unnest(range(p - {SPAN - 1}, p + 1)) AS start FROM m SEMI JOIN dense USING (doc_id, item_no, diagonal)),
win AS (SELECT DISTINCT doc_id, item_no, start FROM (SELECT doc_id, item_no, diagonal, start, count(*) AS n FROM s
  WHERE start >= greatest(0, diagonal) AND start + {SPAN} <= stop GROUP BY ALL HAVING count(*) >= {LEAST})),
short AS (SELECT DISTINCT doc_id, item_no, d.p AS start, b.n FROM d JOIN b ON b.p = 0 AND b.n < {SPAN} AND d.w = b.w AND d.ws[d.p + 1:d.p + b.n] = b.ws)
SELECT doc_id, item_id, count(*) AS n_windows, min(start) AS doc_start, max(start) + {SPAN} AS doc_end FROM win JOIN items USING (item_no) GROUP BY doc_id, item_no, item_id
UNION ALL SELECT doc_id, item_id, count(*), min(start), max(start) + s.n FROM short s JOIN items USING (item_no) GROUP BY doc_id, item_no, item_id, s.n
"""
}
QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}

"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import hash_bitmap, probe
from . import textkit as tk
from .textkit import durable, read

#: Rolling hash of a line i: (value of line i + FACTOR * value of line i - 1) modulo PRIME.
FACTOR, PRIME = 31337, 2**31 - 1
_LIMIT = (1 << 63) - 1
_SPACE = " \t\n\v\f\r"


def cut(text: str) -> tuple[list[str], list[int]]:
    r"""Lines (\n-split) of a text, and where its chunks begin, with the number of lines at the end.

    A line's value is the first four bytes of its MD5. A chunk ends after each
    line whose rolling hash over two lines is below the one before and not
    above the one after; that depends on four lines only, so an insertion
    shifts no boundary beyond it, and inner chunks have two lines or more.
    """
    lines = text.split("\n")
    value = np.array([int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:4], "big") for x in lines], np.int64)
    rolled = (value[1:] + FACTOR * value[:-1]) % PRIME  # of lines 1, 2, ...
    least = np.flatnonzero((rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] <= rolled[2:])) + 2
    return lines, [0, *(least + 1).tolist(), len(lines)]


def _chunks(text: str) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the chunks of two lines or more that have a word."""
    lines, starts = cut(text)
    for no, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
        if j - i >= 2:
            chunk = "\n".join(lines[i:j])
            if chunk.strip(" \t\n\v\f\r"):
                yield no, chunk.encode("utf-8", "surrogatepass")


def _key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), text))


def _texts(documents: DataFrame) -> DataFrame:
    # the doc_id is widened here, so that other names and types of it don't matter further on
    return documents.select(_key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _chunk_hashes(texts: DataFrame) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for key, doc, text in zip(keys, ids, batch.column(2), strict=True):
                for no, chunk in _chunks(text.as_py()):
                    digest = hashlib.md5(chunk).digest()
                    rows.append((key, doc, no, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "doc_id", "no", "h1", "h2"])

    return texts.mapInArrow(tk.lean(go), "key string, doc_id long, no long, h1 long, h2 long")


def _chunk_texts(texts: DataFrame, bitmap) -> DataFrame:
    """The chunks that may be repeated, with their bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            keys, ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for key, doc, text in zip(keys, ids, batch.column(2), strict=True):
                for no, chunk in _chunks(text.as_py()):
                    h1 = int.from_bytes(hashlib.md5(chunk).digest()[:8], "big", signed=True)
                    if probe(bits, np.array([h1], np.int64))[0]:
                        rows.append((key, doc, no, h1, chunk))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc_id", "no", "h1", "chunk"])

    return texts.mapInArrow(tk.lean(go), "key string, doc_id long, no long, h1 long, chunk binary")


def repeated_chunks(documents: DataFrame) -> DataFrame:
    """(key, no) of every chunk whose bytes occur at an earlier place: smaller doc_id, then key, then number.

    Hashes are counted first, with partial counts before the shuffle. Only
    chunks whose hash recurs (as a bitmap of fixed size tells, with few
    others) are moved with their bytes, and only equal bytes count as repeats.
    """
    texts = _texts(documents)
    again = _chunk_hashes(texts).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
    bitmap = documents.sparkSession.sparkContext.broadcast(hash_bitmap(again, "h1"))
    chunks = tk.scanned(_chunk_texts(texts, bitmap))
    bitmap.destroy()
    place = F.struct(F.coalesce("doc_id", F.lit(_LIMIT)).alias("doc_id"), "key", "no")
    first = durable(chunks.groupBy("h1", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    return chunks.join(first, ["h1", "chunk"]).where((F.col("key") != F.col("first.key")) | (F.col("no") != F.col("first.no"))).select("key", "no").distinct()


def _cut_out(documents: DataFrame, removed: DataFrame, kept_of: Callable[[str, set[int]], tuple[list[str], int]], pieces: str) -> DataFrame:
    """row (a struct of all columns) and cut (what kept_of() leaves of the text without its removed (key, no), n_lines_before, n_lines_removed, pieces)."""
    gone = removed.groupBy("key").agg(F.collect_set("no").alias("gone"))
    rows = documents.select(F.struct("*").alias("row"), _key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("key"))
    joined = rows.join(gone, "key", "left")
    added = ("n_lines_before", "n_lines_removed", pieces)

    @F.pandas_udf(f"text string, {', '.join(f'{c} long' for c in added)}")
    def strip(texts, gone):
        import pandas as pd

        out = []
        for text, numbers in zip(texts, gone, strict=True):
            if text is None:
                out.append((None, 0, 0, 0))
                continue
            n = text.count("\n") + 1
            if numbers is None:
                out.append((text, n, 0, 0))
                continue
            kept, cuts = kept_of(text, set(map(int, numbers)))
            out.append(("\n".join(kept), n, n - len(kept), cuts))
        return pd.DataFrame(out, columns=["text", *added])

    return joined.select("row", strip(F.col("row.text"), F.col("gone")).alias("cut"))


def _flat(cut: DataFrame, documents: DataFrame, text_as: str) -> DataFrame:
    added = [c for c in cut.schema["cut"].dataType.names if c != "text"]
    names = [c for c in documents.columns if c.lower() not in added]
    return cut.select(*((F.col("cut.text").alias(text_as) if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in names), *(f"cut.{c}" for c in added))


def _without_chunks(text: str, drop: set[int]) -> tuple[list[str], int]:
    lines, starts = cut(text)
    return [x for no, (i, j) in enumerate(zip(starts, starts[1:], strict=False)) if no not in drop for x in lines[i:j]], len(drop)


def dedup_lines(documents: DataFrame, text_as: str = "text") -> DataFrame:
    """documents with the repeated chunks cut out of text, and n_lines_before, n_lines_removed, n_chunks_removed (long).

    The first place of a chunk keeps it, the others lose its lines. A text of
    which nothing is left is empty and has all its lines removed. A null text
    stays null, with no lines. Rows with equal doc_id and text are one
    document repeated and get the same result; null doc_ids come last. All
    other columns are carried along, but for those named as an added one, in
    whose place that comes; cut_chunks() keeps these too, in a struct.
    """
    return _flat(cut_chunks(documents), documents, text_as)


def cut_chunks(documents: DataFrame) -> DataFrame:
    """dedup_lines() as two structs: row with all columns of documents, and cut with text, n_lines_before, n_lines_removed, n_chunks_removed."""
    return _cut_out(documents, repeated_chunks(documents), _without_chunks, "n_chunks_removed")


def _windows(text: str) -> Iterator[tuple[int, bytes]]:
    """(first line, bytes) of every two lines in a row that have a word."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    for no, (a, b) in enumerate(zip(lines, lines[1:], strict=False)):
        if a.strip() or b.strip():
            yield no, a + b"\n" + b


def _head(window: bytes) -> int:
    return int.from_bytes(hashlib.md5(window).digest()[:8], "big", signed=True)


def _window_hashes(texts: DataFrame) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, n = np.unique(np.array([_head(window) for text in batch.column(2) for _, window in _windows(text.as_py())], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(n.astype(np.int64))], names=["h1", "n"])

    return texts.mapInArrow(tk.lean(go), "h1 long, n long")


def _window_texts(texts: DataFrame, bitmap) -> DataFrame:
    """The windows that may be repeated, with their bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            keys, ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for key, doc, text in zip(keys, ids, batch.column(2), strict=True):
                found = list(_windows(text.as_py()))
                heads = np.array([_head(window) for _, window in found], np.int64)
                rows.extend((key, doc, found[i][0], int(heads[i]), found[i][1]) for i in np.flatnonzero(probe(bits, heads)).tolist())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc_id", "no", "h1", "window"])

    return texts.mapInArrow(tk.lean(go), "key string, doc_id long, no long, h1 long, window binary")


def repeated_windows(documents: DataFrame) -> DataFrame:
    """(key, no) of every two-line window that occurs at an earlier place (as in repeated_chunks()) with which it has no line in common.

    A passage of two lines or more is repeated just when all its windows are,
    so these windows cover the repeated passages of any length from their
    first line to their last, whatever is around them. As in
    repeated_chunks(), hashes find them and equal bytes decide.
    """
    texts = _texts(documents)
    again = _window_hashes(texts).groupBy("h1").agg(F.sum("n").alias("n")).where("n > 1").select("h1")
    bitmap = documents.sparkSession.sparkContext.broadcast(hash_bitmap(again, "h1"))
    windows = tk.scanned(_window_texts(texts, bitmap))
    bitmap.destroy()
    place = F.struct(F.coalesce("doc_id", F.lit(_LIMIT)).alias("doc_id"), "key", "no")
    first = durable(windows.groupBy("h1", "window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    return windows.join(first, ["h1", "window"]).where((F.col("key") != F.col("first.key")) | (F.col("no") > F.col("first.no") + 1)).select("key", "no")


def _without_windows(text: str, drop: set[int]) -> tuple[list[str], int]:
    """The lines in no window of drop, and the number of passages cut; blank lines go with them where no kept line is beside them."""
    lines = text.split("\n")
    gone = [i in drop or i - 1 in drop for i in range(len(lines))]
    kept, passages = [], 0
    runs = [(out, [lines[i] for i in at]) for out, at in groupby(range(len(lines)), gone.__getitem__)]
    blank = [not out and not any(x.strip(_SPACE) for x in run) for out, run in runs]
    for out, alike in groupby(zip(runs, blank, strict=True), lambda x: x[0][0] or x[1]):
        if out:
            passages += 1
        else:
            kept += [x for (_, run), _ in alike for x in run]
    return kept, passages


def dedup_passages(documents: DataFrame, text_as: str = "text") -> DataFrame:
    """As dedup_lines(), for whole passages: every line goes that is in a passage of two lines or more (one with a word) found at an earlier place; n_passages_removed in place of n_chunks_removed.

    The first place of a line always keeps it, and a copy of a text of two
    lines or more loses all its lines.
    """
    return _flat(cut_passages(documents), documents, text_as)


def cut_passages(documents: DataFrame) -> DataFrame:
    """dedup_passages() as two structs: row with all columns of documents, and cut with text, n_lines_before, n_lines_removed, n_passages_removed."""
    return _cut_out(documents, repeated_windows(documents), _without_windows, "n_passages_removed")


def op2_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = {
    "op2_line_chunk_dedup": f"""
WITH d AS (SELECT doc_id, text, md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), coalesce(text, ''))) AS key FROM documents),
l AS (SELECT doc_id, key, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM (SELECT doc_id, key, string_split(coalesce(text, ''), chr(10)) AS ls FROM d)),
v AS (SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS v FROM l),
r AS (SELECT *, (v + {FACTOR} * lag(v) OVER w) % {PRIME} AS r FROM v WINDOW w AS (PARTITION BY key ORDER BY i)),
e AS (SELECT *, coalesce(r < lag(r) OVER w AND r <= lead(r) OVER w, false) AS ends FROM r WINDOW w AS (PARTITION BY key ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
chunk AS (SELECT doc_id, key, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines FROM c GROUP BY ALL),
gone AS (SELECT key, no, lines FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, key, no) AS k FROM chunk WHERE lines > 1 AND regexp_matches(chunk, '[^\\x20\\x09-\\x0D]')) WHERE k > 1),
kept AS (SELECT key, string_agg(line, chr(10) ORDER BY i) AS text FROM c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.key = c.key AND g.no = c.no) GROUP BY key),
cost AS (SELECT key, sum(lines)::BIGINT AS lines, count(*) AS chunks FROM gone GROUP BY key)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines_before,
  coalesce(lines, 0) AS n_lines_removed, coalesce(chunks, 0) AS n_chunks_removed FROM d LEFT JOIN kept USING (key) LEFT JOIN cost USING (key)
"""
}
QUERIES = {"op2_line_chunk_dedup": op2_line_chunk_dedup}

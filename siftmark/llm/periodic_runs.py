"""Periodic runs of words: suffix trees of a document and of its reversal, Lyndon roots, constant-time extensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

#: A run is at least so many words long, and at least so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words of a gram that every run holds three times or more (it holds LEAST_TIMES periods), wherever in the run it begins.
_GRAM = 3
_MIX = tk.constants(_GRAM + 1, 11)
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_tree(letters: list[int], size: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of letters (numbers under size, the last one found nowhere else).

    The child of a node by an edge's first letter has the key node * size + letter; node 0 is the root. An edge is
    letters[start : end] of its lower node; a leaf's end is the end of the text, so open edges need no care.
    """
    n = len(letters)
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = along = waiting = 0
    for i, letter in enumerate(letters):
        waiting += 1
        unlinked = 0
        while waiting:
            if not along:
                edge = i
            key = node * size + letters[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                first = start[below]
                span = end[below] - first
                if along >= span:
                    node, edge, along = below, edge + span, along - span
                    continue
                if letters[first + along] == letter:
                    if unlinked:
                        link[unlinked] = node
                    along += 1
                    break
                middle = len(start)
                start += (first, i)
                end += (first + along, n)
                link += (0, 0)
                start[below] = first + along
                child[key] = middle
                child[middle * size + letter] = middle + 1
                child[middle * size + letters[first + along]] = below
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            waiting -= 1
            if node:
                node = link[node]
            elif along:
                along -= 1
                edge = i - waiting + 1
    return child, start, end


class Extensions:
    """Longest common extensions of two places of a text: the depth of two leaves' lowest common ancestor.

    The Euler tour of the tree comes to the leaves in the order of the suffixes; of the nodes that it passes between two
    leaves, the lowest common ancestor is the least deep. A table of minima over spans of the tour answers in constant
    time, for whole arrays of pairs. It takes 4 log2(n) bytes a word.
    """

    def __init__(self, letters: list[int], size: int):
        n = len(letters)
        child, start, end = suffix_tree(letters, size)
        keys, kids = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        del child
        order = np.argsort(keys)[::-1]  # a stack gives the last one first
        parents, kids = keys[order] // size, kids[order]
        counts = np.bincount(parents, minlength=len(start))
        stop = np.cumsum(counts[::-1])[::-1].tolist()
        first = (np.cumsum(counts[::-1])[::-1] - counts).tolist()
        kids, width = kids.tolist(), (np.array(end) - np.array(start)).tolist()
        depth, leaves, came = [0] * len(start), [], []
        stack, fresh, turn = [0], True, 0
        up = [0] * len(start)
        while stack:
            v = stack.pop()
            above = depth[up[v]]
            if fresh:  # where the tour turned after the last leaf
                turn, fresh = above, False
            depth[v] = above + width[v]
            a, b = first[v], stop[v]
            if a == b:
                leaves.append(n - depth[v])
                came.append(turn)
                fresh = True
            else:
                for kid in kids[a:b]:
                    up[kid] = v
                stack += kids[a:b]
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self._minima = [np.array(came, np.int32)]
        while 2 << (len(self._minima) - 1) <= n:
            last, half = self._minima[-1], 1 << (len(self._minima) - 1)
            self._minima.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from the places i and j on are equal; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self._minima[k][low[at]], self._minima[k][high[at] - (1 << k) + 1])
        return out


def lyndon_roots(rank: list[int]) -> Iterator[tuple[int, int]]:
    """(place, length) of the longest Lyndon word at every place, for the order of the letters and for the opposite one: it ends where the next smaller, or greater, suffix begins."""
    smaller: list[int] = []
    greater: list[int] = []
    for i, r in enumerate(rank):
        while smaller and rank[smaller[-1]] > r:
            yield (j := smaller.pop()), i - j
        while greater and rank[greater[-1]] < r:
            yield (j := greater.pop()), i - j
        smaller.append(i)
        greater.append(i)


def _stretches(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be in a run, and the number of the stretch of each.

    Each gram of a run stands in it three times or more, so words without such a gram in their stretch can't be in one;
    they cut stretches, and what is left is looked at again until nothing more goes.
    """
    at, part = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    while len(at) >= LEAST_WORDS:
        w = codes[at].astype(np.uint64)
        key = w[:-2] * _MIX[0] + w[1:-1] * _MIX[1] + w[2:] * _MIX[2] + part[:-2].astype(np.uint64) * _MIX[3]
        whole = np.flatnonzero(part[:-2] == part[2:])
        whole = whole[np.argsort(key[whole], kind="stable")]
        key = key[whole]
        many = np.zeros(len(key), bool)
        three = np.flatnonzero(key[2:] == key[:-2])
        many[three] = many[three + 1] = many[three + 2] = True
        stays = np.zeros(len(at), bool)
        for k in range(_GRAM):
            stays[whole[many] + k] = True
        cut = np.ones(len(at), bool)  # whether a stretch begins
        cut[1:] = (part[1:] != part[:-1]) | ~stays[:-1]
        kept = np.flatnonzero(stays)
        number = np.cumsum(cut)[kept]
        if len(kept):
            sizes = np.bincount(number)
            fits = sizes[number] >= LEAST_WORDS
            kept, number = kept[fits], number[fits]
        done = len(kept) == len(at)
        at, part = at[kept], number
        if done:
            return at, part
    return at[:0], part[:0]


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted by start and period; words are equal where their numbers are."""
    at, part = _stretches(codes)
    if not len(at):
        return []
    # letters from 1 on; each cut is a letter of its own, and so is the end
    _, letters = np.unique(codes[at], return_inverse=True)
    cuts = np.flatnonzero(np.diff(part)) + 1
    letters = np.insert(letters + 1, cuts, int(letters.max()) + 2 + np.arange(len(cuts)))
    places = np.insert(at, cuts, -1)
    n, size = len(letters), int(letters.max()) + 1
    right, left = Extensions([*letters.tolist(), 0], size), Extensions([*letters[::-1].tolist(), 0], size)
    roots = np.fromiter((x for root in lyndon_roots(right.rank.tolist()) for x in root), np.int64).reshape(-1, 2)
    i, period = roots[:, 0], roots[:, 1]
    begin = i - left.common(n - i, n - i - period)
    stop = i + period + right.common(i, i + period)
    good = stop - begin >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    found = set(zip(places[begin[good]].tolist(), (stop - begin)[good].tolist(), period[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _one_text(text: str | None) -> tuple[int, list[dict], str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at just \x20 and \x09 to \x0D
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    runs = find_runs(codes) if len(words) - len(numbers) >= 2 * _GRAM - 1 else []
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return len(codes), [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words that no run repeats, joined by one space): one row per row.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch whose words q apart are equal, q being the smallest such number,
    that no neighbouring word extends, of at least 6 words and at least 4 q. Its words after the first q are repeats.
    Every run is found: words that can't be in one only cut the text before the trees are built. Null and empty texts
    have no words and an empty collapsed text; a null doc_id is kept, repeated rows each keep theirs, and columns other
    than doc_id and text are not read. A row's work is by itself; a tree takes some 0.5 KB a word that may be in a run.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, rows = batch.column(0), 0, []
            begun = 0
            for i, text in enumerate(batch.column(1)):
                rows.append(_one_text(text.as_py()))
                size += len(rows[-1][2])
                if size > 1 << 22 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids[begun : i + 1], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _RUNS), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                    begun, size, rows = i + 1, 0, []

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tk.lean(go), RUNS)


_WORDS = r"[^\x20\x09-\x0D]+"


def _with_repeats() -> Column:
    """The query's text: every tenth document by a hash of its doc_id goes on, from a word on, with a stretch of it over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.expr("crc32(cast(doc_id as string)) div 10"), F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    times = (F.lit(3) + g % 8).cast("int")
    p = (F.lit(1) + F.floor((n - a) / times)).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times + 1)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.col("text"))


def op11_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(tk.read(spark, sf_dir, "documents").select("doc_id", _with_repeats().alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n", "")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Runs in SQL: pairs of equal grams of one document by distance, and stretches of such pairs.
SQL = {
    "op11_suffix_tree_runs": rf"""
WITH h AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS ws, row_number() OVER () AS rn,
  xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM documents),
g AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
t AS (SELECT rn, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS ws FROM g),
w AS (SELECT rn, unnest(range(n)) AS i, unnest(ws) AS word FROM t),
grams AS (SELECT rn, i, word || ' ' || lead(word) OVER (PARTITION BY rn ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY rn ORDER BY i) AS gram FROM w),
twice AS (SELECT x.rn, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rn = y.rn AND x.gram = y.gram AND x.i < y.i),
spans AS (SELECT rn, q, min(i) AS start, count(*) + q + 2 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rn, q ORDER BY i) AS island FROM twice) GROUP BY rn, q, island),
runs AS (SELECT rn, start, length, min(q) AS q FROM spans WHERE length >= greatest({LEAST_WORDS}, {LEAST_TIMES} * q) GROUP BY rn, start, length),
best AS (SELECT rn, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, q := q), (-length, start, q)) AS b,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM runs GROUP BY rn),
gone AS (SELECT DISTINCT rn, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN gone USING (rn, i) GROUP BY rn)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (rn) LEFT JOIN kept USING (rn)
"""
}
QUERIES = {"op11_suffix_tree_runs": op11_suffix_tree_runs}

"""Line and token differences of pairs, and overlap of their lines."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import LANGUAGES, lexeme_pattern
from .intake import LARGE_CHARS, LARGE_LINES

# Fixed value: lines of a changed block on either side up to which its tokens are compared.
TOKEN_LINES = 100
#: Pairs of elements that one table of bits may have; larger ones are halved first, so memory stays linear in the texts.
CELLS = 1 << 26


def _rows(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """For each prefix of a, a number with a 0 bit at each j where a common subsequence with b[: j + 1] is longer than with b[:j]."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(row: int, m: int) -> np.ndarray:
    """Lengths of the longest common subsequence with the first 0, 1, ... m elements, of one of _rows()."""
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def _matches(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, found from the end: equal ends match, else a's end is left out where that costs nothing, else b's."""
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    out, i, j = [], len(a), len(b)
    longest = (rows[i] & (1 << j) - 1).bit_count() if j else 0
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
            longest = (rows[i] & (1 << j) - 1).bit_count()
        elif (above := (rows[i - 1] & (1 << j) - 1).bit_count()) <= longest:
            i, longest = i - 1, above
        else:
            j -= 1
            longest = (rows[i] & (1 << j) - 1).bit_count()
    return out[::-1]


def common_places(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """(i, j) of a longest common subsequence of a and b, in order.

    Tables of bits, 64 elements a step. A pair with more than CELLS pairs of
    elements is cut where the best ways through both halves of a meet, and so
    on, so no table grows with the product of the lengths.
    """
    names: dict[Hashable, int] = {}
    x, y = ([names.setdefault(v, len(names)) for v in side] for side in (a, b))
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS or n - i == 1:
            out += [(i + p, j + q) for p, q in _matches(x[i:n], y[j:m])]
            continue
        half = (i + n) // 2
        for up in _rows(x[i:half], y[j:m]):
            pass
        for down in _rows(x[half:n][::-1], y[j:m][::-1]):
            pass
        best = j + int((_lengths(up, m - j) + _lengths(down, m - j)[::-1]).argmax())
        todo += [(i, half, j, best), (half, n, best, m)]
    return sorted(out)


def edit_script(a: Sequence, b: Sequence, key: Callable[..., Hashable] = lambda x: x) -> list[tuple[str, int, int]]:
    """A shortest script from a to b: (equal, i, j), (delete, i, -1) and (insert, -1, j); between equal elements deletions come before insertions.

    Elements are equal if their keys are.
    """
    out: list[tuple[str, int, int]] = []
    i = j = 0
    for p, q in [*common_places([key(x) for x in a], [key(y) for y in b]), (len(a), len(b))]:
        out += [("delete", k, -1) for k in range(i, p)] + [("insert", -1, k) for k in range(j, q)]
        if p < len(a):
            out.append(("equal", p, q))
        i, j = p + 1, q + 1
    return out


def blocks(script: list[tuple[str, int, int]]) -> list[tuple[str, list[int], list[int]]]:
    """Runs of one kind with their places on both sides; a deletion and the insertion after it make a modification."""
    out: list[tuple[str, list[int], list[int]]] = []
    for kind, i, j in script:
        if not out or out[-1][0] != kind:
            out.append((kind, [], []))
        if i >= 0:
            out[-1][1].append(i)
        if j >= 0:
            out[-1][2].append(j)
    merged: list[tuple[str, list[int], list[int]]] = []
    for kind, i, j in out:
        if merged and kind == "insert" and merged[-1][0] == "delete":
            merged[-1] = ("modify", merged[-1][1], j)
        else:
            merged.append((kind, i, j))
    return merged


OPS = "assignment_id string, a long, b long, op_no int, type string, a_start int, a_end int, b_start int, b_end int, token_equal int, token_delete int, token_insert int, truncated boolean"


def _tokens(text: str, language: str) -> list[tuple[str, str]]:
    import regex

    spec = LANGUAGES[language]
    out = []
    for x in regex.findall(f"(?:{lexeme_pattern(spec)})".replace(r"\z", r"\Z"), text):
        kind = (spec.operators | spec.keywords).get(x) or ("NUM" if x[0].isdigit() else "VAR" if x[0].isalpha() or x[0] in "_$" else "STR" if x[0] in "\"'`" else None)
        if kind:
            out.append((kind, x))
    return out


def token_key(token: tuple[str, str]) -> Hashable:
    """Names are equal by their text, all other tokens by their type."""
    return token if token[0] == "VAR" else token[0]


def pair_diff(pairs: DataFrame, line_key: Callable[[str], Hashable] = str.strip, token_lines: int | None = TOKEN_LINES, large: tuple[int, int] | None = (LARGE_LINES, LARGE_CHARS)) -> DataFrame:
    """OPS of pairs (assignment_id, a, b, code_a, code_b, language): blocks of lines that are equal by line_key, deleted, inserted or modified.

    Modified blocks carry the counts of their token script. A pair of more
    lines or characters than large, or a block of over token_lines lines, has
    none and is marked truncated; None for either sets no such limit. Pairs
    are spread over tasks; one pair's script is found in one. Null code is
    empty.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OPS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 7, pa.bool_()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                left, right = (r["code_a"] or "").split("\n"), (r["code_b"] or "").split("\n")
                long = large is not None and (len(left) + len(right) > large[0] or len(r["code_a"] or "") + len(r["code_b"] or "") > large[1])
                script = edit_script(left, right, line_key)
                for no, (kind, i, j) in enumerate(blocks(script)):
                    counts = {"equal": None, "delete": None, "insert": None}
                    cut = kind == "modify" and (long or (token_lines is not None and max(len(i), len(j)) > token_lines))
                    if kind == "modify" and not cut:
                        sides = [_tokens("\n".join(text[p] for p in at), r["language"]) for text, at in ((left, i), (right, j))]
                        if all(sides):
                            edits = [t for t, _, _ in edit_script(*sides, token_key)]
                            counts = {t: edits.count(t) for t in counts}
                    lines = [x for at in (i, j) for x in ((at[0] + 1, at[-1] + 1) if at else (None, None))]
                    rows.append((r["assignment_id"], r["a"], r["b"], no, kind, *lines, *counts.values(), cut))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pairs.select("assignment_id", "a", "b", "code_a", "code_b", "language").mapInArrow(go, OPS)


def diff_stats(ops: DataFrame) -> DataFrame:
    """assignment_id, a, b, regions, equal_lines, insertions, deletions, modifications of each pair; a modification counts its longer side."""
    a, b = F.col("a_end") - F.col("a_start") + 1, F.col("b_end") - F.col("b_start") + 1
    total = lambda kind, n: F.coalesce(F.sum(F.when(F.col("type") == kind, n)), F.lit(0))
    return ops.groupBy("assignment_id", "a", "b").agg(
        F.count_if(F.col("type") == "equal").alias("regions"), total("equal", a).alias("equal_lines"), total("insert", b).alias("insertions"), total("delete", a).alias("deletions"), total("modify", F.greatest(a, b)).alias("modifications")
    )


def line_overlap(pairs: DataFrame, code: DataFrame) -> DataFrame:
    """assignment_id, a, b, common, only_a, only_b: trimmed lines with their multiplicity, as sets go; nothing is aligned."""
    lines = code.select("assignment_id", "submission_id", F.explode(F.transform(F.split("code", "\n"), lambda x: F.trim(x))).alias("line"))
    counts = lines.groupBy("assignment_id", "submission_id", "line").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("assignment_id", "submission_id").agg(F.sum("n").alias("lines"))
    side = lambda df, s, value: df.select("assignment_id", F.col("submission_id").alias(s), *([F.col("line")] if "line" in df.columns else []), F.col(value).alias(f"{value}_{s}"))
    wanted = pairs.select("assignment_id", "a", "b").distinct()
    both = wanted.join(side(counts, "a", "n"), ["assignment_id", "a"]).join(side(counts, "b", "n"), ["assignment_id", "b", "line"])
    common = both.groupBy("assignment_id", "a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    out = wanted.join(common, ["assignment_id", "a", "b"], "left").join(side(total, "a", "lines"), ["assignment_id", "a"]).join(side(total, "b", "lines"), ["assignment_id", "b"])
    n = F.coalesce("common", F.lit(0))
    return out.select("assignment_id", "a", "b", n.alias("common"), (F.col("lines_a") - n).alias("only_a"), (F.col("lines_b") - n).alias("only_b"))

"""Fingerprints by Arrow batches: the same lexemes and hashes of code, and hashes of prose, as tokens and fingerprint find, for a hundredth of a token row's work."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.hashing import BASE, MODULUS, value_of
from ..functions.lexicons import Language, lexeme_pattern

#: Lexemes whose values a task remembers for each language; then it begins anew. Words of prose that are hashed at once (a text is never cut).
_REMEMBERED, _AT_ONCE = 100_000, 1_000_000


def _compiled(pattern: str) -> re.Pattern:
    r"""A pattern of Java's for Python, whose end of the text is \Z."""
    return re.compile(re.sub(r"(?<!\\)((?:\\\\)*)\\z", r"\1\\Z", pattern), re.ASCII)


def readable(languages: Mapping[str, Language]) -> bool:
    """Whether Python reads the patterns of all languages; a user's own may be in Java's syntax alone."""
    try:
        return all(_compiled(p).groups == 0 for spec in languages.values() for p in (lexeme_pattern(spec), *(s for s, _ in spec.strings)))
    except re.error:
        return False


class _Lexer:
    """tokens._value() of the lexemes of one language."""

    def __init__(self, spec: Language):
        self.pieces = _compiled(lexeme_pattern(spec))
        self.strings = [_compiled(p) for p, _ in spec.strings]
        self.table = {lexeme: value_of(kind) for lexeme, kind in (spec.operators | spec.keywords).items()}
        self.directives, self.known = spec.directives, {}

    def value(self, x: str) -> int:
        """The hash of a lexeme's type; -1 for what makes no token."""
        first = x[0]
        if first in " \n\t\r":
            return -1
        if self.directives and first == "#":
            return value_of("INCLUDE")
        if x in self.table:
            return self.table[x]
        if any(s.fullmatch(x) for s in self.strings):
            return value_of("STR")
        if first in "0123456789":
            return value_of("NUM")
        return value_of("VAR") if first.isascii() and (first.isalpha() or first in "_$") else -1

    def read(self, code: str, lines: bool) -> tuple[list[int], list[int]]:
        """The values of the tokens and their lines."""
        known, pieces = self.known, self.pieces.findall(code)
        if len(known) > _REMEMBERED:
            known.clear()
        for x in set(pieces).difference(known):
            known[x] = self.value(x)
        values = [known[x] for x in pieces]
        if not lines:
            return [v for v in values if v >= 0], []
        line, places = 1, []
        for x, v in zip(pieces, values, strict=True):
            if v >= 0:
                places.append(line)
            if "\n" in x:
                line += x.count("\n")
        return [v for v in values if v >= 0], places


def _winnowed(values: np.ndarray, n: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, hash, pos of the winnowed k-grams of texts whose token values stand one after the other, n of each."""
    starts, grams = np.cumsum(n) - n, np.maximum(n - k + 1, 0)
    text = np.repeat(np.arange(len(n)), grams)
    first = np.cumsum(grams) - grams
    pos = np.arange(len(text)) - first[text]
    at = starts[text] + pos
    hashes = values[at] % MODULUS
    for j in range(1, k):
        hashes = (hashes * BASE + values[at + j]) % MODULUS
    # the rightmost of the least: hashes above reversed positions; windows of one text end with it
    places, last = (hashes << 32) | (0xFFFFFFFF - pos), (first + grams - 1)[text]
    least = places.copy()
    for j in range(1, w):
        least = np.minimum(least, places[np.minimum(np.arange(len(text)) + j, last)])
    least = least[pos <= np.maximum(grams[text] - w, 0)]
    text = text[pos <= np.maximum(grams[text] - w, 0)]
    # least ones move to the right alone, so equal ones stand together
    fresh = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))[: len(least)]
    return text[fresh], least[fresh] >> 32, 0xFFFFFFFF - (least[fresh] & 0xFFFFFFFF)


def _lists(text: np.ndarray, hashes: np.ndarray, n: int) -> pa.ListArray:
    """Each of n texts' hashes once, as a list that rises."""
    once = np.unique((text << 32) | hashes)  # hashes are below 2 ** 30
    offsets = np.searchsorted(once, np.arange(n + 1) << 32).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(once & 0xFFFFFFFF))


def fingerprint_batches(rows: DataFrame, languages: Mapping[str, Language], k: int, w: int, sets: bool | str) -> DataFrame:
    """The keys of rows (keys, then code and language) with hash, pos, start_line, end_line of their fingerprints, or with each hash once if sets; if that is "arrays", every row with hashes, an array."""
    keys = rows.columns[:-2]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    specs = dict(languages)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexers = {name: _Lexer(spec) for name, spec in specs.items()}
        for batch in batches:
            values, lines, n = [], [], []
            for code, language in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                found, places = lexers[language].read(code, not sets) if language in lexers else ([], [])
                values += found
                lines += places
                n.append(len(found))
            n = np.array(n, np.int64)
            text, hashes, pos = _winnowed(np.array(values, np.int64), n, k, w)
            if sets == "arrays":
                text, columns = np.arange(len(n)), [_lists(text, hashes, len(n))]
            elif sets:
                once = np.unique(np.stack([text, hashes]), axis=1) if len(text) else np.zeros((2, 0), np.int64)
                text, columns = once[0], [pa.array(once[1], pa.int64())]
            else:
                line, at = np.array(lines, np.int32), (np.cumsum(n) - n)[text] + pos
                columns = [pa.array(hashes, pa.int64()), *(pa.array(c.astype(np.int32)) for c in (pos, line[at], line[at + k - 1]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(text)) for i in range(len(keys))), *columns], names=[*keys, *names])

    names, given = {"arrays": (["hashes"], ["hashes array<long>"]), True: (["hash"], ["hash long"]), False: (["hash", "pos", "start_line", "end_line"], ["hash long", "pos int", "start_line int", "end_line int"])}[sets]
    return rows.mapInArrow(find, ", ".join([*kinds, *given]))


class _Words:
    """value_of() of the words of Arrow arrays, each distinct one of a batch once."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def values(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        known, distinct = self.known, coded.dictionary.to_pylist()
        for x in set(distinct).difference(known):
            known[x] = value_of(x)
        return np.array([known[x] for x in distinct], np.int64)[coded.indices.to_numpy()]


def prose_batches(rows: DataFrame, k: int, w: int, give: str) -> DataFrame:
    """The keys of rows (keys, then words, an array of strings) with what give names of their fingerprints: hash and pos ("prints"), hashes ("arrays"; every row), or n_tokens, n_kgrams and n_fingerprints ("counts"; every row).

    Filters on what comes of it stay behind it: of array functions Spark puts
    another copy into each filter and generator, and all of them are computed
    again.
    """
    keys = rows.columns[:-1]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    given = {"prints": "hash long, pos int", "arrays": "hashes array<long>", "counts": "n_tokens long, n_kgrams long, n_fingerprints long"}[give]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = _Words(), [*keys, *(x.split()[0] for x in given.split(", "))]
        for whole in batches:
            words = whole.column(len(keys))
            sums, at = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(sums):
                end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _AT_ONCE, "right")))
                batch = whole.slice(at, end - at)
                n = np.diff(np.concatenate([[sums[at - 1] if at else 0], sums[at:end]])).astype(np.int64)
                text, hashes, pos = _winnowed(known.values(words.slice(at, end - at).flatten()), n, k, w)
                if give == "prints":
                    columns = [pa.array(hashes, pa.int64()), pa.array(pos.astype(np.int32))]
                elif give == "arrays":
                    text, columns = np.arange(len(n)), [_lists(text, hashes, len(n))]
                else:
                    columns = [pa.array(c.astype(np.int64)) for c in (n, np.maximum(n - k + 1, 0), np.bincount(text, minlength=len(n)))]
                    text = np.arange(len(n))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(text)) for i in range(len(keys))), *columns], names=names)
                at = end

    return rows.mapInArrow(find, ", ".join([*kinds, given]))

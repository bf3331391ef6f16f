"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk

WINDOW = 4096
#: Words and other pieces whose ids a Python worker remembers; with more it begins anew, which costs time alone.
MAX_PIECES = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Fixed value: a splitter that drops white space and makes tokens of runs of letters, single digits and runs of all else.
_WORDS_ONLY = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Kinds of bytes: ASCII letters, ASCII signs that are tokens by themselves wherever they stand, and all that is neither (0).
_LETTER, _SIGN = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in "'<"]] = _SIGN
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain_steps(path: str) -> bool:
    """Whether the tokeniser of this file lower-cases, splits by _WORDS_ONLY and maps bytes to characters, and nothing else that bears on words of letters."""
    own = json.loads(Path(path).read_text(encoding="utf-8"))
    before, split = own.get("normalizer") or {}, own.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in before.get("normalizers", [])]
    first, last = [*split.get("pretokenizers", []), {}, {}][:2]
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and before["normalizers"][1].get("pattern") == {"Regex": "\\s+"} and len(split.get("pretokenizers", [])) == 2
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORDS_ONLY} and first.get("behavior") == "Removed" and bool(first.get("invert"))
        and last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex")
    )


def _byte_characters() -> dict[int, str]:
    """Bytes as byte-level tokenisers write them: visible ones of Latin-1 as they are, the others by the characters from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(seen)]
    return {x: chr(x) for x in seen} | {x: chr(256 + i) for i, x in enumerate(rest)}


def _kinds(data: np.ndarray) -> np.ndarray:
    """_KIND of every byte; both bytes of an accented letter of Latin-1 are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] & 0xC0 == 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Encoder:
    """Ids of whole texts by a tokenizers file.

    Of a tokeniser of the form of _plain_steps(), the words and signs of a
    chunk of texts are named by 64-bit hashes, each new one is encoded once,
    and the ids of all are gathered from one array; pieces between spaces with
    anything but Latin letters and plain signs are encoded whole. Other
    tokenisers get the whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), _plain_steps(path)
        self.characters = _byte_characters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 12, np.uint32), 0

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_word(self, word: str) -> list[int]:
        """Ids of a run of letters or of signs: what is left of the tokeniser's steps for it."""
        return [t.id for t in self.tokenizer.model.tokenize(word.lower().encode().decode("latin-1").translate(self.characters))]

    def _learn(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for some in ids for x in some), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(self.used, len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        places = np.searchsorted(self.keys, keys)
        self.keys, self.n = np.insert(self.keys, places, keys), np.insert(self.n, places, n)
        self.at = np.insert(self.at, places, self.used + np.cumsum(n) - n)
        self.used += len(flat)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8 bytes and their offsets), and where each text's ids begin (one more at the end)."""
        if not self.by_word:
            ids = [self._encode(data[a:b].tobytes().decode("utf-8", "surrogatepass")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([x for some in ids for x in some], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        starts, ends = tk.runs(tk.NOT_SPACE[data], offsets)
        kind = _kinds(data)
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        plain = odd[ends] == odd[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[plain]] = 1
        inside[ends[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)  # bytes of the pieces that are cut into words and signs
        cuts = np.flatnonzero(inside[1:] & inside[:-1] & (kind[1:] != kind[:-1])) + 1
        cuts = cuts[~np.isin(cuts, starts, assume_unique=True)]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        low = np.where(inside & _UPPER[data], data | np.uint8(0x20), data)
        hashes = tk.span_hashes(tk.sums(low, tk.EXACT), starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        keys, one = ordered[new], order[new]
        if len(self.keys) + len(keys) > MAX_PIECES:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        unknown = place == len(self.keys)
        unknown[~unknown] = self.keys[place[~unknown]] != keys[~unknown]
        if unknown.any():
            found = [(data[a:b].tobytes().decode("utf-8", "surrogatepass"), word) for a, b, word in zip(starts[one[unknown]].tolist(), ends[one[unknown]].tolist(), inside[starts[one[unknown]]].tolist(), strict=True)]
            self._learn(keys[unknown], [self._encode_word(x) if word else self._encode(x) for x, word in found])
            place = np.searchsorted(self.keys, keys)
        of = np.empty(len(hashes), np.int64)
        of[order] = place[np.cumsum(new) - 1]
        n = self.n[of]
        begin = np.concatenate([[0], np.cumsum(n)])
        return self.pool[np.arange(begin[-1]) + np.repeat(self.at[of] - begin[:-1], n)], begin[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs one task's documents as they come.

    levels[h] counts the open windows that hold h tokens. A piece of s tokens
    goes to the level h (0: a new window) that makes the sum of squared counts
    after the move least, among those with h + s <= window; ties go to the
    lowest level. Whole windows are cut off longer documents first.
    """

    def __init__(self, window: int = WINDOW, first_id: int = 0):
        self.window, self.next_id = window, first_id
        self.levels = np.zeros(window + 1, np.int64)
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4, np.int64)  # what taking a window from a level adds
        self.leave[0] = 0
        self.enter = np.ones(window + 1, np.int64)  # what one more window at a level adds
        self.enter[window] = 0
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def _count(self, level: int, by: int) -> None:
        n = self.levels[level] = self.levels[level] + by
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.enter[level] = 2 * n + 1
        self.n_open += by

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, width, start = len(ids) // 4, 4 * self.window, 0
        while total - start >= self.window:
            self._close([(doc, start, ids[4 * start : 4 * start + width], total)])
            start += self.window
        if s := total - start:
            change = self.leave[: self.window - s + 1] + self.enter[s:]
            level = int(change.argmin())
            pieces = []
            if level:
                pieces = self.open[level].pop()
                self._count(level, -1)
            pieces.append((doc, start, ids[4 * start :], total))
            self._put(level + s, pieces)

    def _put(self, level: int, pieces: list) -> None:
        if level == self.window:
            self._close(pieces)
        elif level:
            self.open.setdefault(level, []).append(pieces)
            self._count(level, 1)

    def _refill(self) -> None:
        """Fill the fullest windows with what the emptiest hold; at most one stays open."""
        windows = [[level, pieces] for level in sorted(self.open) for pieces in self.open[level]]
        for level in self.open:
            self._count(level, -int(self.levels[level]))
        self.open.clear()
        i, j = 0, len(windows) - 1
        while i < j:
            room = self.window - windows[j][0]
            doc, start, ids, total = windows[i][1].pop()
            n = len(ids) // 4
            take = min(room, n)
            windows[j][1].append((doc, start, ids[: 4 * take], total))
            windows[j][0] += take
            windows[i][0] -= take
            if take < n:
                windows[i][1].append((doc, start + take, ids[4 * take :], total))
            if windows[j][0] == self.window:
                self._close(windows[j][1])
                j -= 1
            if not windows[i][1]:
                i += 1
        if i == j:
            self._put(windows[i][0], windows[i][1])

    def finish(self) -> None:
        """Refill, then cut the last window into sequences of a power of two, which need no padding."""
        self._refill()
        rest = [p for level in self.open.values() for pieces in level for p in pieces]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            now = []
            while room:
                doc, start, ids, total = rest.pop(0)
                take = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * take], total))
                room -= take
                if 4 * take < len(ids):
                    rest.insert(0, (doc, start + take, ids[4 * take :], total))
            self._close(now)
            left -= size
        self.open.clear()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every scan task packs its own documents, so nothing is shuffled and a lost
    task repeats alone; sequence ids carry the partition's number in their
    upper bits. Only the last sequences of a task, of a power of two tokens
    each, are shorter than the window. A null or empty text is the end id
    alone; repeated rows are packed as often as they occur; a null doc_id is
    kept; other columns are not read.
    """
    path = tokenizer_path or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(path).ids, Packer(window, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, _, data, offsets in tk.text_chunks(batch.column(1)):
                ids, first = encode(data, offsets)
                ids = ids.astype("<u4", copy=False).tobytes()
                for k, (a, b) in enumerate(zip((4 * first[:-1]).tolist(), (4 * first[1:]).tolist(), strict=True)):
                    packer.add(docs[i + k], ids[a:b] + end)
            if len(packer.out) >= 2_000:
                yield _table(packer.drain())
        packer.finish()
        yield _table(packer.drain())

    return documents.select("doc_id", "text").mapInArrow(tk.lean(pack), SCHEMA)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(tk.read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_sum_of_squares_packing": op6_sum_of_squares_packing}

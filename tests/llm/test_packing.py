import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from siftmark.llm import packing, textkit
from siftmark.llm.packing import Encoder, Packer, default_tokenizer, pack_documents

TOKENIZER = Tokenizer.from_file(default_tokenizer())
TEXTS = ["", None, "Hello, world! Hello", "a <|endoftext|>b", "it's x's 'LL", "Ὀδυσσεύς ΟΔΟΣ İx", "été ½ 日本 \x1c\x1f\x85  z", "w,. ,," * 3, "naïve#1|2 %%%"]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def encoded(encoder, texts):
    out = []
    for _, _, data, offsets in textkit.text_chunks(pa.array(texts, pa.string())):
        ids, first = encoder.ids(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


ENCODER = Encoder(default_tokenizer())
LATIN = st.text("abzABZéÉßÿ×÷ŒœΣσς'<|>_-.,!019 \t\n\x0b\x1c\x85\xa0\u0301\u3000tsrevmdlL", max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(LATIN | st.text(max_size=60) | st.none(), max_size=5))
def test_encoder_equals_tokenizer(texts):
    assert encoded(ENCODER, texts) == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_that_begins_anew(monkeypatch):
    monkeypatch.setattr(packing, "MAX_PIECES", 4)
    encoder = Encoder(default_tokenizer())
    for n in (1, 2, 1):
        texts = [f"alpha beta{'x' * n}, gamma delta", "Gamma alpha."]
        for t in texts:
            assert encoded(encoder, [t]) == [TOKENIZER.encode(t, add_special_tokens=False).ids]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Encoder(path)
    assert ENCODER.by_word and not other.by_word
    texts = [t for t in TEXTS if t is not None]
    assert encoded(other, texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packer_places_every_token_once(sizes):
    packer = Packer(window=16)
    docs = {d: np.arange(1000 * d, 1000 * d + n, dtype="<u4") for d, n in enumerate(sizes)}
    for d, ids in docs.items():
        packer.add(d, ids.tobytes())
    packer.finish()
    rows, fill = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, total, seq, at in packer.drain():
        assert n > 0 and total == len(docs[doc]) and crc == zlib.crc32(docs[doc][start : start + n].tobytes())
        rows[doc].append((start, n))
        fill[seq].append((at, n))
    for parts, whole in [(rows[d], len(ids)) for d, ids in docs.items()] + [(f, sum(n for _, n in f)) for f in fill.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == whole
    for f in fill.values():
        size = sum(n for _, n in f)
        assert size <= 16 and size & (size - 1) == 0  # full, or a power of two: nothing is padded


def test_level_choice_is_the_least_sum_of_squares():
    packer = Packer(window=10)
    rng = np.random.default_rng(3)
    counts = np.zeros(11, int)
    for s in rng.integers(1, 10, 300):
        options = {}
        for h in range(0, 11 - s):
            if h == 0 or counts[h]:
                after = counts.copy()
                after[h] -= h > 0
                after[h + s] += h + s < 10
                options[h] = int((after[1:10] ** 2).sum())
        best = min(options, key=lambda h: (options[h], h))
        counts[best] -= best > 0
        counts[best + s] += best + s < 10
        packer.add(0, np.zeros(s, "<u4").tobytes())
        assert (packer.levels[1:10] == counts[1:10]).all()


def test_pack_documents(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x y", None), (0, "", "again"), (50, "word, " * 9000, "long")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset string")).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
    for doc, text, _ in rows:
        if doc == 0:
            assert [(r.start, r.length, r.doc_tokens) for r in whole[0]] == [(0, 1, 1)] * 2
            continue
        ids, at = np.array(ids_of(text), "<u4"), 0
        for r in sorted(whole[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

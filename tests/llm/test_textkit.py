import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.llm import textkit as tk
from siftmark.llm.bitmaps import bitmap_of, hash_bitmap, probe

TEXT = st.text(alphabet=st.sampled_from("aAbZ09 \n\t\r\x0b\x1c\x85é日-"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 40))
def test_words_equal_regex(texts, limit):
    for kind, pattern in ((tk.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (tk.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        seen = []
        for i, j, data, offsets in tk.text_chunks(pa.array(texts, pa.string()), limit):
            words, starts, ends, first = tk.words_of(data, offsets, kind, tk.FOLDED)
            for k in range(j - i):
                got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
                assert got == re.findall(pattern, texts[i + k] or "")
                folded = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in got]
                seen += list(zip(folded, words[first[k] : first[k + 1]].tolist(), strict=True))
        assert len({w for w, _ in seen}) == len(set(seen)) == len({h for _, h in seen})


def test_sliced_arrays():
    array = pa.array(["zero", "one two", None, "x"]).slice(1, 2)
    assert [(i, j, bytes(d)) for i, j, d, _ in tk.text_chunks(array)] == [(0, 2, b"one two")]


def test_bitmaps_agree(spark):
    hashes = tk.constants(500, 99).view(np.int64)
    frame = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    assert hash_bitmap(frame, "h", 18) == bitmap_of(hashes, 18)
    bits = np.frombuffer(bitmap_of(hashes, 18), np.uint8)
    assert probe(bits, hashes).all() and probe(bits, tk.constants(500, 98).view(np.int64)).mean() < 0.01
    assert not probe(np.frombuffer(hash_bitmap(frame.limit(0), "h", 18), np.uint8), hashes).any()

"""Bitmaps of fixed size over 64-bit hashes: cheap tests inside tasks before an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**24 bits, 2 MB, whatever the size of the data: a fuller bitmap lets more candidates through to the exact step, none is lost.
BITS = 24
_BUCKET = 1 << 15


def hash_bitmaps(hashes: DataFrame, columns: list[str], bits: int = BITS) -> list[bytes]:
    """For each column a bit for each of two slices of every hash; at most 2**bits / 8 bytes a column reach the driver."""
    ones = (1 << bits) - 1
    places = [F.struct(F.lit(no).alias("no"), (part.bitwiseAND(ones) + 1).alias("place")) for no, c in enumerate(columns) for part in (F.col(c), F.shiftrightunsigned(c, 32))]
    parts = hashes.select(F.explode(F.array(*places)).alias("x")).groupBy("x.no", F.bitmap_bucket_number("x.place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x.place")).alias("part"))
    out = [bytearray((1 << bits) // 8) for _ in columns]
    for no, bucket, part in parts.collect():
        at = (bucket - 1) * _BUCKET // 8
        out[no][at : at + len(part)] = part
    return [bytes(x) for x in out]


def hash_bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> bytes:
    return hash_bitmaps(hashes, [column], bits)[0]


def bitmap_of(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """As hash_bitmap, of hashes at hand."""
    out = np.zeros(1 << bits, bool)
    h = hashes.view(np.uint64)
    for part in (h, h >> np.uint64(32)):
        out[(part & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the bitmap (bits: its bytes)."""
    mask = np.uint64(8 * len(bits) - 1)
    h = hashes.view(np.uint64)
    low, high = h & mask, (h >> np.uint64(32)) & mask
    hit = (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 != 0
    at = np.flatnonzero(hit)
    high = high[at]
    hit[at] = (bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return hit

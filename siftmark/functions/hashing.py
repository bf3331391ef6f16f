"""Hashes of token types and k-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the polynomial hash.
BASE, MODULUS = 31, 1_000_000_007


def token_value(kind: Column) -> Column:
    """Polynomial hash of a token type's characters; 0 for an empty one."""
    zero = F.lit(0).cast("long")
    return F.aggregate(F.split(kind, ""), zero, lambda total, c: (total * BASE + F.ascii(c)) % MODULUS)


def horner(values: list[Column]) -> Column:
    """Polynomial hash of a k-gram from the values of its tokens; stays within 64 bits."""
    total = values[0] % MODULUS
    for v in values[1:]:
        total = (total * BASE + v) % MODULUS
    return total


def value_of(kind: str) -> int:
    """token_value() of a type that is known beforehand."""
    total = 0
    for c in kind:
        total = (total * BASE + ord(c)) % MODULUS
    return total

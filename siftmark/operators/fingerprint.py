"""K-grams, their hashes, and winnowing: as windows over token rows, and inside one row by batches of texts (lexing)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import BASE, MODULUS, horner, token_value
from ..functions.lexicons import LANGUAGES, Language
from .lexing import fingerprint_batches, prose_batches, readable
from .tokens import KEYS, code_values, prose_words, with_language

# Tokens in a k-gram, and k-grams in a window.
K, W = 5, 4


def _by_position() -> Window:
    return Window.partitionBy(*KEYS).orderBy("pos")


def kgrams(tokens: DataFrame, k: int = K) -> DataFrame:
    """KEYS, pos, kgram: the types of k consecutive tokens; none where fewer are left. k must be positive."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    ahead = [F.lead("type", j).over(_by_position()) for j in range(k)]
    return tokens.select(*KEYS, "pos", F.array(*ahead).alias("kgram"), F.lead("pos", k - 1).over(_by_position()).alias("last")).where("last is not null").drop("last")


def kgram_hashes(tokens: DataFrame, k: int = K) -> DataFrame:
    """KEYS, hash, pos, start_line, end_line of every k-gram. Values are computed once for each row's type and led along the window."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    valued = tokens.select(*KEYS, "pos", "line", token_value(F.col("type")).alias("value"))
    ahead = [F.lead("value", j).over(_by_position()) for j in range(k)]
    hashed = valued.select(*KEYS, horner(ahead).alias("hash"), "pos", F.col("line").alias("start_line"), F.lead("line", k - 1).over(_by_position()).alias("end_line"))
    return hashed.where("end_line is not null")


def winnow(hashes: DataFrame, w: int = W) -> DataFrame:
    """The rightmost least hash of every w consecutive ones, once; of w or fewer the rightmost least of all. w must be positive."""
    if w <= 0:
        raise ValueError(f"w must be positive, got {w}")
    ahead = _by_position().rowsBetween(0, w - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    at = F.row_number().over(_by_position())
    least = F.min(F.struct("hash", (-F.col("pos")).alias("back"), "start_line", "end_line")).over(ahead)
    picked = hashes.select(*KEYS, least.alias("m"), n.alias("n"), at.alias("at")).where(F.col("at") <= F.greatest(F.col("n") - w + 1, F.lit(1)))
    return picked.select(*KEYS, "m.hash", (-F.col("m.back")).alias("pos"), "m.start_line", "m.end_line").distinct()


def fingerprints(tokens: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """KEYS, hash, pos, start_line, end_line: the winnowed k-gram hashes."""
    return winnow(kgram_hashes(tokens, k), w)


def fingerprint_counts(submissions: DataFrame, tokens: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """KEYS, n_tokens, n_kgrams, n_fingerprints of every submission, zeros included."""
    count = lambda df, name: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
    hashes = kgram_hashes(tokens, k)
    out = submissions.select(*KEYS)
    for df, name in ((tokens, "n_tokens"), (hashes, "n_kgrams"), (winnow(hashes, w), "n_fingerprints")):
        out = out.join(count(df, name), list(KEYS), "left")
    return out.select(*KEYS, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_kgrams", "n_fingerprints")))


_PLACES = (1 << 32) - 1


def _kgram_array(values: Column, k: int) -> Column:
    """Hashes of all k-grams of an array of token values; horner() along k arrays, each shifted by one."""
    n = F.greatest(F.size(values) - (k - 1), F.lit(0))
    total = F.transform(F.slice(values, F.lit(1), n), lambda v: v % MODULUS)
    for j in range(1, k):
        total = F.zip_with(total, F.slice(values, F.lit(j + 1), n), lambda h, v: (h * BASE + v) % MODULUS)
    return total


def _winnow_array(places: Column, w: int, kind: str = "bigint") -> Column:
    """Distinct least values of every w consecutive ones, or of all if there are w or fewer."""
    n = F.size(places) - (w - 1)
    some = F.greatest(n, F.lit(0))
    least = F.slice(places, F.lit(1), some)
    for j in range(1, w):
        least = F.zip_with(least, F.slice(places, F.lit(j + 1), some), lambda a, b: F.least(a, b))
    return F.when(n > 1, F.array_distinct(least)).when(F.size(places) > 0, F.array(F.array_min(places))).otherwise(F.array().cast(f"array<{kind}>"))


def _worded(texts: DataFrame, k: int, w: int) -> DataFrame:
    """KEYS, words of texts (KEYS, text)."""
    if k <= 0 or w <= 0:
        raise ValueError(f"k and w must be positive, got {k} and {w}")
    return texts.select(*KEYS, prose_words(F.col("text")).alias("words"))


def prose_fingerprints(texts: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """fingerprints(prose_tokens(texts)) of texts (KEYS, text; one row each), in each row: nothing is shuffled, and only fingerprints become rows."""
    found = prose_batches(_worded(texts, k, w), k, w, "prints")
    return found.select(*KEYS, "hash", "pos", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))


def prose_counts(texts: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """fingerprint_counts() of texts (KEYS, text), in each row."""
    return prose_batches(_worded(texts, k, w), k, w, "counts")


def prose_arrays(texts: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """KEYS, hashes: prose_sets(), each set as an array of its row, which is a third of what its rows are."""
    return prose_batches(_worded(texts, k, w), k, w, "arrays")


def prose_sets(texts: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """KEYS, hash: distinct_hashes(prose_fingerprints(texts)), in each row."""
    return prose_arrays(texts, k, w).select(*KEYS, F.explode("hashes").alias("hash"))


def code_arrays(submissions: DataFrame, k: int = K, w: int = W, languages: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """KEYS, hashes: code_sets(), each set as an array of its row."""
    if k <= 0 or w <= 0:
        raise ValueError(f"k and w must be positive, got {k} and {w}")
    if readable(languages):
        return fingerprint_batches(with_language(submissions, languages), languages, k, w, "arrays")
    hashed = code_values(submissions, languages, lines=False).select(*KEYS, _kgram_array(F.col("tokens"), k).alias("hashes"))
    places = hashed.select(*KEYS, F.transform("hashes", lambda h, i: h * (_PLACES + 1) + (_PLACES - i)).alias("places"))
    return places.select(*KEYS, F.array_distinct(F.transform(_winnow_array(F.col("places"), w), lambda p: F.shiftright(p, 32))).alias("hashes"))


def code_sets(submissions: DataFrame, k: int = K, w: int = W, languages: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """KEYS, hash: distinct_hashes(fingerprints(tokenize_any(submissions))) of submissions (one row each), in each row: only the sets become rows."""
    if k > 0 and w > 0 and readable(languages):
        return fingerprint_batches(with_language(submissions, languages), languages, k, w, True)
    return code_arrays(submissions, k, w, languages).select(*KEYS, F.explode("hashes").alias("hash"))


def code_fingerprints(submissions: DataFrame, k: int = K, w: int = W, languages: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """fingerprints(tokenize_any(submissions)) of submissions (one row each), in each row; a k-gram carries its lines along, so that only fingerprints become rows.

    Batches of texts are read by lexing; patterns that Python can't read are
    left to array functions, as in code_sets().
    """
    if k <= 0 or w <= 0:
        raise ValueError(f"k and w must be positive, got {k} and {w}")
    if readable(languages):
        return fingerprint_batches(with_language(submissions, languages), languages, k, w, False)
    valued = code_values(submissions, languages)
    n = F.greatest(F.size("tokens") - (k - 1), F.lit(0))
    split = valued.select(*KEYS, F.transform("tokens", lambda t: t["value"]).alias("values"), F.transform(F.slice("tokens", F.lit(1), n), lambda t, i: F.struct((-i).alias("back"), t["line"].alias("s"))).alias("starts"), F.transform(F.slice("tokens", F.lit(k), n), lambda t: t["line"]).alias("ends"))
    hashed = split.select(*KEYS, _kgram_array(F.col("values"), k).alias("hashes"), F.zip_with("starts", "ends", lambda a, e: F.struct(a["back"].alias("back"), a["s"].alias("s"), e.alias("e"))).alias("lines"))
    grams = hashed.select(*KEYS, F.zip_with("hashes", "lines", lambda h, x: F.struct(h.alias("h"), x["back"].alias("back"), x["s"].alias("s"), x["e"].alias("e"))).alias("grams"))
    picked = grams.select(*KEYS, F.explode(_winnow_array(F.col("grams"), w, "struct<h: bigint, back: int, s: int, e: int>")).alias("p"))
    return picked.select(*KEYS, F.col("p.h").alias("hash"), (-F.col("p.back")).alias("pos"), F.col("p.s").alias("start_line"), F.col("p.e").alias("end_line"))

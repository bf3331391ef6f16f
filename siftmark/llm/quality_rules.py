"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Values from here on share the last bin of a sketch, so a sketch has at most so many bins and one.
TOP = 2048
#: Metric: (numerator, denominator, scale, middle and outer rank in percent, how many times their distance a fence lies beyond the outer one, whether low values are rejected too).
#: Ranks, not values: where most texts have none of a thing (repeats of lines and words come in good texts too), the outer rank is further out.
METRICS = {
    "word_length": ("word_chars", "n_words", 100, 50, 90, 3, True),
    "symbols": ("n_symbols", "word_chars", 1000, 50, 90, 3, False),
    "upper": ("n_upper", "word_chars", 1000, 90, 99, 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 90, 99, 1, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 90, 99, 1, False),
}
#: To a group's sketch its language's is added with the weight of so many documents, and to that of a language the one of all.
PRIOR = 20


def _per_text(where: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes or items lie in each text."""
    total = np.zeros(len(where) + 1, np.int64)
    np.cumsum(where, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of values that occur twice or more, and of occurrences after the first."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    later, many = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def count_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text, over all of it."""
    n = len(offsets) - 1
    is_word = tk.NOT_SPACE[data]
    starts, ends = tk.runs(is_word, offsets)
    prefix = tk.sums(data, tk.EXACT)
    words, first = tk.span_hashes(prefix, starts, ends), np.searchsorted(starts, offsets)
    salt = tk.constants(n, 3)
    grams = tk.gram_hashes(words, 3)
    owner = np.repeat(np.arange(n), np.diff(first))
    inside = np.zeros(len(words), bool)
    if len(grams):
        at = np.flatnonzero(owner[: len(grams)] == owner[2:])
        many, _ = _repeated(grams[at] ^ salt[owner[at]])
        for j in range(3):
            inside[at[many] + j] = True
    newlines = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([newlines + 1, offsets[:-1]]))
    line_start = line_start[line_start < len(data)]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(newlines, len(data))[np.searchsorted(newlines, line_start)], offsets[line_owner + 1])
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_owner = line_start[full], line_end[full], line_owner[full]
    _, later = _repeated(tk.span_hashes(prefix, line_start, line_end) ^ salt[line_owner])
    return [
        np.diff(first),
        _per_text(is_word & ~_CONTINUES[data], offsets),
        _per_text(_SYMBOL[data], offsets),
        np.bincount(line_owner[later], minlength=n),
        _per_text(inside, first),
        np.bincount(line_owner, minlength=n),
        _per_text(_UPPER[data], offsets),
    ]


def count_words(documents: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id (id_type), lang, source and COUNTS of every document."""
    names = ("doc_id", "lang", "source", *COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tk.text_chunks(batch.column(3)):
                kept = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x.astype(np.int64)) for x in count_texts(data, offsets))], names=list(names))

    rows = documents.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(tk.lean(count), f"doc_id {id_type}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _value(metric: str) -> Column:
    top, bottom, scale = METRICS[metric][:3]
    return F.when(F.col(bottom) > 0, F.least(F.floor(F.col(top) * scale / F.col(bottom)), F.lit(TOP)).cast("long")).otherwise(F.lit(0).cast("long"))


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(counts: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: how many documents of a language and source have a metric in a bin.

    Sketches merge by adding counts, in any order, with the same result; the
    error of a quantile is below one bin (1/1000, or 1/100 of a character).
    Documents that fail the base rules are left out.
    """
    bins = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _value(m).alias("bin")) for m in METRICS)))
    return counts.where(~_base_failed()).select("lang", "source", bins.alias("b")).groupBy("lang", "source", "b.metric", "b.bin").agg(F.count(F.lit(1)).alias("n"))


def _with_prior(own: DataFrame, keys: list[str], prior: DataFrame, prior_keys: list[str]) -> DataFrame:
    """own sketches (keys, metric, bin, weight), each with the one of prior (prior_keys, metric, bin, weight) added as PRIOR documents.

    Weights are whole numbers: a document of own counts as many times as prior
    has weight, one of prior PRIOR times its weight; so nothing is rounded.
    """
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}")) for k in prior_keys] + [F.col("o.metric") == F.col("p.metric")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    total = prior.groupBy(*prior_keys, "metric").agg(F.sum("weight").cast("decimal(38,0)").alias("total"))
    mine = own.alias("o").join(total.alias("p"), on).select(*(F.col(f"o.{k}") for k in keys), "o.metric", "o.bin", (F.col("o.weight") * F.col("p.total")).cast("decimal(38,0)").alias("weight"))
    groups = own.select(*keys, "metric").distinct()
    theirs = groups.alias("o").join(prior.alias("p"), on).select(*(F.col(f"o.{k}") for k in keys), "o.metric", "p.bin", (F.col("p.weight") * PRIOR).cast("decimal(38,0)").alias("weight"))
    return mine.unionByName(theirs).groupBy(*keys, "metric", "bin").agg(F.sum("weight").cast("decimal(38,0)").alias("weight"))


def thresholds(bins: DataFrame) -> DataFrame:
    """lang, source, metric, low, high: fences at quantiles of each group's sketch, and a fitted tail beyond them.

    A fence lies beyond the outer rank by so many times its distance from the
    middle rank (an exponential tail loses an equal share over each such
    distance), and by one bin, the error of the sketch. Groups with few
    documents lean on their language, by weights that hold for all sizes.
    """
    weigh = lambda keys: bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").cast("decimal(38,0)").alias("weight"))
    every, lang, own = weigh([]), weigh(["lang"]), weigh(["lang", "source"])
    merged = _with_prior(own, ["lang", "source"], tk.durable(_with_prior(lang, ["lang"], every, [])), ["lang"])
    whole = Window.partitionBy("lang", "source", "metric")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most TOP + 1 rows
    ranked = merged.withColumn("upto", F.sum("weight").over(upto)).withColumn("all", F.sum("weight").over(whole))
    of = lambda i: F.element_at(F.create_map(*(x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v[i])))), F.col("metric"))
    at = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("all") * share, F.col("bin")))
    found = ranked.groupBy("lang", "source", "metric").agg(at(of(3)).alias("mid"), at(of(4)).alias("outer"), at(100 - of(3)).alias("low_mid"), at(100 - of(4)).alias("low_outer"))
    high = F.col("outer") + of(5) * (F.col("outer") - F.col("mid")) + 1
    low = F.col("low_outer") - of(5) * (F.col("low_mid") - F.col("low_outer")) - 1
    return found.select("lang", "source", "metric", F.when(of(6), low).alias("low"), high.alias("high"))


def judge(documents: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed (names of the metrics outside their fences).

    base_failed: under 50 words, or over half of them in repeated three-word
    windows. kept: not base_failed, and no metric beyond its fences. Null and
    empty texts have no words and fail; null languages and sources are groups
    of their own; repeated rows each get their row; a group in which all fail
    the base rules has no fences. Other columns are not read.
    """
    counts = tk.scanned(count_words(documents, id_type))
    limits = thresholds(sketch(counts))
    wide = tk.durable(
        limits.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(
            *(F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("low", "high"))
        )
    )
    joined = counts.join(wide, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    outside = [F.when((_value(m) > F.col(f"high_{m}")) | (_value(m) < F.coalesce(f"low_{m}", F.lit(-1))), F.lit(m)) for m in METRICS]
    failed = F.array_join(F.array_compact(F.array(*outside)), ",")
    base = _base_failed()
    return joined.select("doc_id", *COUNTS[:5], base.alias("base_failed"), (~base & (failed == "")).alias("kept"), failed.alias("failed"))


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tk.read(spark, sf_dir, "documents"))


def _sql() -> str:
    value = {m: f"CASE WHEN {v[1]} > 0 THEN least(({v[0]} * {v[2]}) // {v[1]}, {TOP}) ELSE 0 END" for m, v in METRICS.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {value[m]} AS bin FROM c WHERE NOT base_failed" for m in METRICS)
    rules = ", ".join(f"('{m}', {v[3]}, {v[4]}, {v[5]}, {str(v[6]).lower()})" for m, v in METRICS.items())
    at = lambda share: f"min(bin) FILTER (upto * 100 >= total * ({share}))"
    fails = ", ".join(
        f"CASE WHEN EXISTS (SELECT 1 FROM lim WHERE metric = '{m}' AND lim.lang IS NOT DISTINCT FROM c.lang AND lim.source IS NOT DISTINCT FROM c.source AND ({value[m]} > high OR {value[m]} < low)) THEN '{m}' END" for m in METRICS
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT x) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS x FROM m) GROUP BY r),
ln AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines FROM ln GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY r),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN wc USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))),
bins AS ({bins}),
own AS (SELECT lang, source, metric, bin, count(*)::HUGEINT AS w FROM bins GROUP BY ALL),
by_lang AS (SELECT lang, metric, bin, sum(w)::HUGEINT AS w FROM own GROUP BY ALL),
every AS (SELECT metric, bin, sum(w)::HUGEINT AS w FROM by_lang GROUP BY ALL),
lang2 AS (SELECT lang, metric, bin, sum(w)::HUGEINT AS w FROM (SELECT lang, metric, bin, w * (SELECT sum(e.w) FROM every e WHERE e.metric = l.metric) AS w FROM by_lang l
  UNION ALL SELECT g.lang, metric, e.bin, e.w * {PRIOR} FROM (SELECT DISTINCT lang, metric FROM by_lang) g JOIN every e USING (metric)) GROUP BY ALL),
own2 AS (SELECT lang, source, metric, bin, sum(w)::HUGEINT AS w FROM (SELECT lang, source, metric, bin, w * (SELECT sum(p.w) FROM lang2 p WHERE p.metric = o.metric AND p.lang IS NOT DISTINCT FROM o.lang) AS w FROM own o
  UNION ALL SELECT g.lang, g.source, g.metric, p.bin, p.w * {PRIOR} FROM (SELECT DISTINCT lang, source, metric FROM own) g JOIN lang2 p ON p.metric = g.metric AND p.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL),
ranked AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, metric) AS total FROM own2),
lim AS (SELECT lang, source, metric, outermost + reach * (outermost - mid) + 1 AS high, CASE WHEN lowtoo THEN low_outer - reach * (low_mid - low_outer) - 1 END AS low FROM (
  SELECT lang, source, metric, {at('any_mid')} AS mid, {at('any_outer')} AS outermost, {at('100 - any_mid')} AS low_mid, {at('100 - any_outer')} AS low_outer, any_value(any_reach) AS reach, any_value(any_low) AS lowtoo
  FROM ranked JOIN (VALUES {rules}) rules(metric, any_mid, any_outer, any_reach, any_low) USING (metric) GROUP BY lang, source, metric)),
j AS (SELECT *, array_to_string(list_filter([{fails}], lambda x: x IS NOT NULL), ',') AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM j
"""


SQL = {"op3_adaptive_quality": _sql()}
QUERIES = {"op3_adaptive_quality": op3_adaptive_quality}

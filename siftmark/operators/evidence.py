"""Matched regions, structural evidence, risk, and the analysis of an assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import kept
from .boilerplate import adjusted_pairs, boilerplate_stats, hash_frequency
from .fingerprint import K, W, code_fingerprints
from .pairs import distinct_hashes, merged
from .tokens import KEYS, tokenize_any
from .versions import latest_version

# Risk limits, lines between regions that still merge, and what the evidence looks at.
HIGH, MEDIUM, LOW = 0.7, 0.4, 0.2
GAP = 2
FIRST_TYPES, LEAST_TYPES, FIRST_NAMES, RENAMED = 20, 5, 10, 0.3
#: Lines of a block that is swept by itself.
COVER_BLOCK = 1 << 16
STRUCTURES = {"loops": ("FOR", "WHILE"), "conditions": ("IF", "ELSE", "ELIF"), "functions": ("DEF", "FUNCTION")}


def risk_level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def raw_regions(prints: DataFrame) -> DataFrame:
    """assignment_id, a, b, hash, sa, sb, ea, eb: the first place on either side of every hash that two submissions share."""
    first = prints.groupBy(*KEYS, "hash").agg(F.min_by(F.struct("start_line", "end_line"), "pos").alias("at"))
    of = lambda side: first.select("assignment_id", F.col("submission_id").alias(side), "hash", F.col("at.start_line").alias(f"s{side}"), F.col("at.end_line").alias(f"e{side}"))
    return of("a").join(merged(of("b")), ["assignment_id", "hash"]).where("a < b").select("assignment_id", "a", "b", "hash", "sa", "sb", "ea", "eb")


def matched_regions(raw: DataFrame) -> DataFrame:
    """assignment_id, a, b, regions (sa, sb, ea, eb, n): raw regions by start, folded while both sides begin at most GAP lines after the last end.

    A pair's regions are at most as many as its hashes, so the sorted fold
    runs over one array. The region at hand is kept beside the closed ones,
    which are copied only when one more is closed.
    """
    region = "struct<sa: int, sb: int, ea: int, eb: int, n: int>"
    collected = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("sa", "sb", "ea", "eb")), F.lit(1).alias("n"))))
    start = F.struct(F.array().cast(f"array<{region}>").alias("done"), F.lit(None).cast(region).alias("last"))

    def fold(state: Column, c: Column) -> Column:
        last = state["last"]
        near = (c["sa"] <= last["ea"] + GAP) & (c["sb"] <= last["eb"] + GAP)
        merged = F.struct(last["sa"].alias("sa"), last["sb"].alias("sb"), F.greatest(last["ea"], c["ea"]).alias("ea"), F.greatest(last["eb"], c["eb"]).alias("eb"), (last["n"] + c["n"]).alias("n"))
        next_one = F.struct(F.concat(state["done"], F.array(last)).alias("done"), c.alias("last"))
        first = F.struct(state["done"].alias("done"), c.alias("last"))
        return F.when(last.isNull(), first).when(near, F.struct(state["done"].alias("done"), merged.alias("last"))).otherwise(next_one)

    grouped = raw.groupBy("assignment_id", "a", "b").agg(collected.alias("raw"))
    return grouped.select("assignment_id", "a", "b", F.aggregate("raw", start, fold, lambda s: F.concat(s["done"], F.array(s["last"]))).alias("regions"))


def line_coverage(regions: Column, side: str) -> Column:
    """How many distinct lines the regions cover on one side: the union of their intervals, by one sweep over their sorted ends with the furthest line so far; no list of lines is made."""
    ends = F.array_sort(F.transform(regions, lambda r: F.struct(r[f"s{side}"].cast("long").alias("first"), r[f"e{side}"].cast("long").alias("last"))))
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(None).cast("long").alias("upto"))

    def sweep(state: Column, r: Column) -> Column:
        begin = F.greatest(r["first"], state["upto"] + 1)  # null is passed over
        return F.struct((state["covered"] + F.greatest(r["last"] - begin + 1, F.lit(0))).alias("covered"), F.greatest(state["upto"], r["last"]).alias("upto"))

    return F.aggregate(ends, start, sweep, lambda s: s["covered"])


def covered_lines(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lines: how many distinct lines the rows (keys, first, last) of each key cover, as rows.

    The same sweep for keys with any number of intervals: they are cut at
    blocks of lines, each block is swept by a window with a running maximum,
    and the blocks' counts are added, so a key is dealt over many tasks. Rows
    with a null end, or one before the first line, cover nothing.
    """
    from_block, to_block = F.floor(F.col("first") / COVER_BLOCK), F.floor(F.col("last") / COVER_BLOCK)
    valid = intervals.where("first <= last").select(*keys, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    # of the blocks that an interval runs over, those in its middle are whole, and only counted
    ends = valid.select(*keys, "first", "last", F.explode(F.array_distinct(F.array(from_block, to_block))).alias("block"))
    low, high = F.col("block") * COVER_BLOCK, (F.col("block") + 1) * COVER_BLOCK - 1
    parts = ends.select(*keys, "block", F.greatest("first", low).alias("first"), F.least("last", high).alias("last"))
    middles = valid.select(*keys, (from_block + 1).alias("first"), (to_block - 1).alias("last")).where("first <= last")

    def union(rows: DataFrame, by: list[str], n: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
        fresh = rows.withColumn("upto", F.max("last").over(before))
        return fresh.select(*by, F.greatest(F.col("last") - F.greatest("first", F.col("upto") + 1) + 1, F.lit(0)).alias(n))

    # blocks that are whole count once, however many middles they are in, and their parts not at all
    whole = union(middles.distinct(), keys, "blocks").groupBy(*keys).agg(F.sum("blocks").alias("blocks"))
    inside = parts.select(*keys, "block").distinct()
    held = inside.alias("i").join(middles.alias("m"), [F.col(f"i.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys] + [F.col("block").between(F.col("m.first"), F.col("m.last"))], "left_semi")
    left = parts.alias("p").join(held.alias("h"), [F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys] + [F.col("p.block") == F.col("h.block")], "left_anti")
    lines = union(left.distinct(), [*keys, "block"], "lines").groupBy(*keys).agg(F.sum("lines").alias("lines"))
    both = lines.select(*keys, "lines").unionByName(whole.select(*keys, (F.col("blocks") * COVER_BLOCK).alias("lines")))
    return both.groupBy(*keys).agg(F.sum("lines").cast("long").alias("lines"))


def structure_counts(tokens: DataFrame) -> DataFrame:
    """KEYS and how many tokens of each structure a submission has."""
    return tokens.groupBy(*KEYS).agg(*(F.count_if(F.col("type").isin(*kinds)).alias(name) for name, kinds in STRUCTURES.items()))


def beginnings(tokens: DataFrame) -> DataFrame:
    """KEYS, types (the first FIRST_TYPES), names (the first FIRST_NAMES of VAR tokens)."""
    nth = F.row_number().over(Window.partitionBy(*KEYS, F.col("type") == "VAR").orderBy("pos"))
    kept = tokens.withColumn("nth", nth).where((F.col("pos") < FIRST_TYPES) | ((F.col("type") == "VAR") & (F.col("nth") <= FIRST_NAMES)))
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", value)))), lambda x: x[value])
    return kept.groupBy(*KEYS).agg(in_order(F.col("pos") < FIRST_TYPES, "type").alias("types"), in_order((F.col("type") == "VAR") & (F.col("nth") <= FIRST_NAMES), "original").alias("names"))


def _sides(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    of = lambda side: facts.select("assignment_id", F.col("submission_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
    return pairs.join(merged(of("a")), ["assignment_id", "a"], "left").join(merged(of("b")), ["assignment_id", "b"], "left")


def structure_flags(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """pairs with same_loops, same_conditions, same_functions: equal counts above 0."""
    joined = _sides(pairs, counts, list(STRUCTURES))
    flags = [F.coalesce((F.col(f"{s}_a") > 0) & (F.col(f"{s}_a") == F.col(f"{s}_b")), F.lit(False)).alias(f"same_{s}") for s in STRUCTURES]
    return joined.select(*(F.col(c) for c in pairs.columns), *flags)


def renaming_flag(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """pairs with renamed: equal first types (LEAST_TYPES at least), and over RENAMED of the first names differ."""
    joined = _sides(pairs, starts, ["types", "names"])
    n = F.least(F.size("types_a"), F.size("types_b"))
    m = F.least(F.size("names_a"), F.size("names_b"))
    differ = F.size(F.filter(F.zip_with(F.slice("names_a", 1, m), F.slice("names_b", 1, m), lambda x, y: x != y), lambda d: d))
    renamed = (n >= LEAST_TYPES) & (F.slice("types_a", 1, n) == F.slice("types_b", 1, n)) & (m > 0) & (differ / m > RENAMED)
    return joined.select(*(F.col(c) for c in pairs.columns), F.coalesce(renamed, F.lit(False)).alias("renamed"))


def evidence_codes() -> Column:
    """Codes of what speaks for a pair, in a fixed order; needs adjusted, overlap, n_regions, lines_a, lines_b, renamed, same_*, n_clean."""
    c = F.col
    codes = [
        F.when(c("adjusted") >= HIGH, "very_high").when(c("adjusted") >= MEDIUM, "moderate").when(c("adjusted") >= LOW, "low_moderate"),
        F.when(c("overlap") > 0, "boilerplate"),
        F.when(c("n_regions") > 0, "regions"),
        F.when((c("n_regions") > 0) & ((c("lines_a") > 5) | (c("lines_b") > 5)), "lines"),
        F.when(c("renamed"), "renamed"),
        *(F.when(c(f"same_{s}"), s) for s in STRUCTURES),
        F.when(c("n_clean") > 0, "clean_matches"),
    ]
    found = F.array_compact(F.array(*codes))
    return F.when(F.size(found) == 0, "none").otherwise(F.array_join(found, ","))


def explanation(pairs: DataFrame) -> DataFrame:
    """analyze()'s rows with a sentence for each code of evidence, in explanation (array)."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    has = lambda code: F.array_contains(F.split("evidence", ","), code)
    say = lambda code, *parts: F.when(has(code), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    lines = [
        say("very_high", "Nearly all of the remaining code agrees (", percent("adjusted"), ")."),
        say("moderate", "A good part of the remaining code agrees (", percent("adjusted"), ")."),
        say("low_moderate", "Some of the remaining code agrees (", percent("adjusted"), ")."),
        say("boilerplate", "Of ", percent("raw"), " agreement, ", percent("overlap"), " is boilerplate."),
        say("regions", F.col("n_regions").cast("string"), " region(s) match."),
        say("lines", "They cover ", F.col("lines_a").cast("string"), " and ", F.col("lines_b").cast("string"), " lines."),
        say("renamed", "Names differ while the structure is the same."),
        *(say(s, f"The same number of {s}.") for s in STRUCTURES),
        say("clean_matches", F.col("n_clean").cast("string"), " fingerprints beyond boilerplate match."),
        say("none", "Nothing speaks for a copy."),
    ]
    return pairs.withColumn("explanation", F.array_compact(F.array(*lines)))


def analyze(submissions: DataFrame, starter: DataFrame | None = None, threshold: float = 0.7, risk_on: str = "raw", k: int = K, w: int = W) -> DataFrame:
    """One row for each pair of latest submissions with a common hash: scores, regions, evidence and risk.

    submissions: assignment_id, submission_id, student_id, version,
    submitted_at, status, language, file_name, code. Tokens are made once a
    submission, not once a pair. risk_on names the score that risk goes by.
    """
    return analyze_latest(kept(latest_version(submissions)), starter, threshold, risk_on, k, w)


def analyze_latest(latest: DataFrame, starter: DataFrame | None = None, threshold: float = 0.7, risk_on: str = "raw", k: int = K, w: int = W) -> DataFrame:
    """analyze() of submissions that are all taken as they are: assignment_id, submission_id, language, file_name, code.

    Tokens go once into the few facts that pairs need of a submission, and
    fingerprints come of the text itself, so no row of a token is kept.
    """
    prints = kept(code_fingerprints(latest, k, w))
    return _analyzed(latest, prints, kept(_facts(tokenize_any(latest))), starter, threshold, risk_on, False)


def _facts(tokens: DataFrame) -> DataFrame:
    """KEYS, n_tokens, structure_counts() and beginnings() of every submission with a token, in one go over its tokens."""
    nth = F.row_number().over(Window.partitionBy(*KEYS, F.col("type") == "VAR").orderBy("pos"))
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", value)))), lambda x: x[value])
    counts = [F.count_if(F.col("type").isin(*kinds)).alias(name) for name, kinds in STRUCTURES.items()]
    starts = [in_order(F.col("pos") < FIRST_TYPES, "type").alias("types"), in_order((F.col("type") == "VAR") & (F.col("nth") <= FIRST_NAMES), "original").alias("names")]
    return tokens.withColumn("nth", nth).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_tokens"), *counts, *starts)


def _analyzed(latest: DataFrame, prints: DataFrame, facts: DataFrame, starter: DataFrame | None, threshold: float, risk_on: str, many: bool) -> DataFrame:
    sets = distinct_hashes(prints)
    stats = boilerplate_stats(hash_frequency(sets, latest, many), starter, threshold)
    regions = matched_regions(raw_regions(prints))
    pairs = adjusted_pairs(sets, stats).join(merged(regions), ["assignment_id", "a", "b"])
    pairs = pairs.withColumns({"n_regions": F.size("regions").cast("long"), "lines_a": line_coverage(F.col("regions"), "a"), "lines_b": line_coverage(F.col("regions"), "b")})
    pairs = structure_flags(renaming_flag(pairs, facts), facts)
    return pairs.withColumns({"evidence": evidence_codes(), "risk": risk_level(F.col(risk_on))})


def text_report(texts: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """One row for every two texts (assignment_id, submission_id, language, file_name, code) of an assignment with a common fingerprint: what analyze() finds, n_tokens and size (fingerprints) of either, regions and explanation.

    For two texts alone, give them an assignment_id of their own.
    """
    texts = kept(texts)
    prints, facts = kept(code_fingerprints(texts, k, w)), kept(_facts(tokenize_any(texts)))
    counts = facts.select(*KEYS, "n_tokens").join(merged(prints.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_fingerprints"))), list(KEYS))
    found = explanation(_analyzed(texts, prints, facts, None, 0.7, "raw", True))
    return _sides(found, counts, ["n_tokens", "n_fingerprints"])

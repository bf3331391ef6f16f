"""Checks of incoming records, files and names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import BULK_UPLOADS, LANGUAGES, UPLOADS
from .language import lookup

# Limits of records.
MAX_CODE_BYTES, LARGE_LINES, LARGE_CHARS = 500 * 1024, 2000, 100_000
MAX_TITLE, MAX_CODE, MAX_DESCRIPTION = 200, 20, 5000
ALLOWED = {
    "python": ["py"], "javascript": ["js", "jsx"], "java": ["java"], "cpp": ["cpp", "cc", "cxx"], "c": ["c"], "csharp": ["cs"],
    "auto": sorted(UPLOADS),
}
GROUP = {"department": "CSE", "division": "D3", "batch": "2023"}
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PROMPT_CHARS, GATE = 3000, 0.7
#: Pairs that a scorer gets at once.
BATCH_ROWS = 64


def dotted_extension(name: Column) -> Column:
    """The extension in lower case; empty without a dot or for a name that only begins with one."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+\.([^.]*)$", 1))


def base_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def ext_language(name: Column, bulk: bool = True) -> Column:
    """Language of an upload by its extension; null if it isn't taken."""
    return lookup(BULK_UPLOADS if bulk else UPLOADS, dotted_extension(name))


def reject_reason(name: Column, code: Column, language_allowed: Column | None = None) -> Column:
    """Why a file isn't accepted; null if it is."""
    reason = F.when(ext_language(name, False).isNull(), "extension").when(F.trim(F.coalesce(code, F.lit(""))) == "", "blank")
    if language_allowed is None:
        return reason
    table = F.create_map(*(x for lang, exts in ALLOWED.items() for x in (F.lit(lang), F.array(*map(F.lit, exts)))))
    return reason.when(~F.array_contains(F.element_at(table, language_allowed), dotted_extension(name)), "language")


def safe_path(path: Column) -> Column:
    """Whether an archive entry stays inside, and is no hidden or system file."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce((path != "") & ~p.contains("../") & ~p.startswith("__MACOSX") & ~p.contains("/."), F.lit(False))


def size_guard(code: Column, other: Column) -> Column:
    """too_big: over the limit of a submission; large: a pair that is compared by lines only."""
    lines = lambda c: F.size(F.split(c, "\n"))
    large = (lines(code) + lines(other) > LARGE_LINES) | (F.length(code) + F.length(other) > LARGE_CHARS)
    return F.struct((F.octet_length(code) > MAX_CODE_BYTES).alias("too_big"), large.alias("large"))


def group_match(student: dict[str, Column], target: dict[str, Column], has_target: Column) -> Column:
    """Whether a student's group is the target's, with defaults for what is missing; everyone matches without a target."""
    return same_group(group_names(student), group_names(target), has_target)


def group_names(group: dict[str, Column]) -> dict[str, Column]:
    """A group in one spelling, with defaults for what is missing; where many pairs are compared, it is made once for each side's rows."""
    return {key: F.upper(F.trim(F.coalesce(group[key], F.lit(default)))) for key, default in GROUP.items()}


def same_group(student: dict[str, Column], target: dict[str, Column], has_target: Column) -> Column:
    """group_match() of group_names()."""
    same = F.lit(True)
    for key in GROUP:
        same = same & (student[key] == target[key])
    return ~has_target | same


def code_key(code: Column) -> Column:
    return F.upper(F.trim(code))


def assignment_code(title: Column, salt: Column) -> Column:
    """Four letters and digits of the title (CODE if there are fewer than two), and a suffix fixed by the salt."""
    prefix = F.substring(F.upper(F.regexp_replace(title, "[^a-zA-Z0-9]", "")), 1, 4)
    return F.concat(F.when(F.length(prefix) < 2, "CODE").otherwise(prefix), F.lit("-"), F.lpad(F.conv(((salt * 7919) % 9000 + 1000).cast("string"), 10, 36), 4, "X"))


def validate(rows: DataFrame, now: Column) -> DataFrame:
    """rows with errors: comma-joined field:rule of every rule of an assignment that fails, in a fixed order.

    Needs title, description, language_allowed, deadline (text), threshold,
    assignment_code, email.
    """
    c = F.col
    when = F.try_to_timestamp(c("deadline"), F.lit("yyyy-MM-dd HH:mm:ss"))
    rules = [
        ("title:length", F.length("title").between(1, MAX_TITLE)),
        ("description:length", F.length(F.coalesce("description", F.lit(""))) <= MAX_DESCRIPTION),
        ("language_allowed:enum", c("language_allowed").isin(*LANGUAGES, "auto")),
        ("deadline:date", when.isNotNull()),
        ("deadline:future", when.isNull() | (when > now)),
        ("threshold:range", F.coalesce("threshold", F.lit(0.5)).between(0.0, 1.0)),
        ("assignment_code:length", F.length(F.coalesce("assignment_code", F.lit(""))) <= MAX_CODE),
        ("email:format", c("email").rlike(EMAIL)),
    ]
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules)))
    return rows.withColumn("errors", F.array_join(failed, ","))


def semantic_candidates(pairs: DataFrame, threshold: Column) -> DataFrame:
    """Pairs worth a costly comparison: adjusted is at least GATE of the assignment's threshold."""
    return pairs.where(F.col("adjusted") >= F.lit(GATE) * threshold)


def prompt_text(code: Column) -> Column:
    return F.when(F.length(code) > PROMPT_CHARS, F.concat(F.substring(code, 1, PROMPT_CHARS), F.lit("\n[cut]"))).otherwise(code)


def semantic_merge(pairs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with semantic: the score of another source, cut to 0..1; null where it is missing or negative."""
    value = F.when(F.col("semantic_score") >= 0, F.least(F.greatest("semantic_score", F.lit(0.0)), F.lit(1.0)))
    return pairs.join(scores, keys, "left").withColumn("semantic", value).drop("semantic_score")


def score_pairs(pairs: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.Series]] | None = None, columns: Sequence[str] = ("prompt_a", "prompt_b"), batch_rows: int = BATCH_ROWS) -> DataFrame:
    """pairs with semantic_score (double), which a scorer of the caller's finds; null for all without one.

    scorer takes an iterator of batches of these columns, of batch_rows pairs
    at most, and gives a series of scores for each: so a model is loaded once a
    task. It runs where the pairs are; all other columns stay where they are
    in the row. A batch whose scores aren't as many as its pairs is an error.
    """
    if scorer is None:
        return pairs.withColumn("semantic_score", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        asked: list[int] = []

        def small() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), batch_rows):
                    part = batch.iloc[at : at + batch_rows].reset_index(drop=True)
                    asked.append(len(part))
                    yield part

        for no, scores in enumerate(scorer(small())):
            if len(scores) != asked[no]:
                raise ValueError(f"the scorer gave {len(scores)} scores for {asked[no]} pairs")
            yield pd.Series(scores, dtype="float64")

    return pairs.withColumn("semantic_score", score(F.struct(*columns)))


def event_details(props: Column, paths: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Typed values of JSON texts: for each name (path, type) the value there, null where the text is broken or null, or has no such value."""
    parsed = F.try_parse_json(props)
    return {name: F.try_variant_get(parsed, path, kind) for name, (path, kind) in paths.items()}

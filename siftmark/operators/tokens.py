"""Normalised tokens as rows, by built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import value_of
from ..functions.lexicons import LANGUAGES, PROSE_PATTERN, Language, lexeme_pattern
from ..sources.durable import spread
from .language import lookup, resolve_language

KEYS = ("assignment_id", "submission_id")


def _by_language(languages: Mapping[str, Language], value: Callable[[Language], Column]) -> Column:
    """value of the row's language; null for others. Only the branch of a row's language is evaluated."""
    return reduce(lambda chain, name: chain.when(F.col("language") == name, value(languages[name])), languages, F.when(F.lit(False), F.lit(None)))


def lexemes(code: DataFrame, languages: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """KEYS, language, i, lexeme, type, original, start, line, column: every lexeme of code (KEYS, code, language) with its token's type (null if it makes none) and text, and the place where it begins (offsets from 0, lines from 1).

    The texts are dealt by their keys before they fall into rows, so the
    windows over their lexemes move nothing. Types are found inside the text's
    row: over rows of lexemes the same expressions would become one method
    that is too long to be compiled.
    """
    pieces = _by_language(languages, lambda spec: F.regexp_extract_all("code", F.lit(lexeme_pattern(spec)), F.lit(0)))
    named = lambda spec: lambda x: F.struct(x.alias("lexeme"), _kind(spec, x).alias("type"), _original(spec, x).alias("original"))
    cut = spread(code.select(*KEYS, "language", "code"), *KEYS).select(*KEYS, "language", pieces.alias("lexemes"))
    found = cut.select(*KEYS, "language", F.posexplode(_by_language(languages, lambda spec: F.transform("lexemes", named(spec)))).alias("i", "x")).select(*KEYS, "language", "i", "x.lexeme", "x.type", "x.original")
    before = Window.partitionBy(*KEYS).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("lexeme") - F.length(F.replace("lexeme", F.lit("\n"), F.lit("")))
    placed = found.withColumn("start", F.coalesce(F.sum(F.length("lexeme")).over(before), F.lit(0))).withColumn("line", F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1)
    after_break = F.when(F.contains("lexeme", F.lit("\n")), F.col("start") + F.length("lexeme") - F.length(F.substring_index("lexeme", "\n", -1)))
    return placed.withColumn("column", F.col("start") - F.coalesce(F.max(after_break).over(before), F.lit(0)))


def _kind(spec: Language, x: Column) -> Column:
    """The type of a lexeme's token; null for what makes none."""
    first = F.substring(x, 1, 1)
    string = reduce(lambda a, b: a | b, [x.rlike(f"\\A(?:{p})\\z") for p, _ in spec.strings])
    kind = F.coalesce(lookup(spec.operators | spec.keywords, x), F.when(string, "STR").when(first.rlike("[0-9]"), "NUM").when(first.rlike("[A-Za-z_$]"), "VAR"))
    kind = F.when(first == "#", "INCLUDE").otherwise(kind) if spec.directives else kind
    # what most lexemes are comes first: no token begins with space
    return F.when(first.isin(" ", "\n", "\t", "\r"), F.lit(None)).otherwise(kind).cast("string")


def _original(spec: Language, x: Column) -> Column:
    """The text that stands for a lexeme in the output."""
    original = x
    for pattern, instead in reversed(spec.strings):
        if instead:
            original = F.when(x.rlike(f"\\A(?:{pattern})\\z"), instead).otherwise(original)
    return F.when(F.substring(x, 1, 1) == "#", F.regexp_extract(x, "^(#[A-Za-z0-9_]*)", 1)).otherwise(original) if spec.directives else original


def _tokens(code: DataFrame, languages: Mapping[str, Language]) -> DataFrame:
    kept = lexemes(code.where(F.trim("code") != ""), languages).where("type is not null")
    pos = F.row_number().over(Window.partitionBy(*KEYS).orderBy("i")) - 1
    return kept.select(*KEYS, pos.alias("pos"), "type", "original", F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), "start", (F.col("start") + F.length("lexeme")).alias("end"))


def tokenize(code: DataFrame, language: str | Language) -> DataFrame:
    """KEYS, pos, type, original, line, column, start, end of code (KEYS, code) in one language, by its name or by a Language of one's own.

    Comments, space and characters the language doesn't know make no token.
    Names become VAR, numbers NUM, literals STR; keywords and operators keep
    their types.
    """
    own = {language: LANGUAGES[language]} if isinstance(language, str) else {"own": language}
    return _tokens(code.select(*KEYS, "code", F.lit(next(iter(own))).alias("language")), own)


def tokenize_any(submissions: DataFrame, languages: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """tokenize() of submissions (KEYS, code, language, file_name), each in its own language, in one pass.

    languages: LANGUAGES, with whatever a user adds under a name of its own;
    names that are not there are resolved by file name and text.
    """
    given = F.when(F.col("language").isin(*languages), F.col("language")).otherwise(resolve_language(F.col("language"), F.col("code"), F.col("file_name")))
    return _tokens(submissions.select(*KEYS, "code", given.alias("language")), languages)


def _value(spec: Language, x: Column) -> Column:
    """The hash of a lexeme's type; null for what makes no token. As _kind(), with numbers in place of types."""
    first = F.substring(x, 1, 1)
    table = F.create_map(*(F.lit(v) for lexeme, kind in (spec.operators | spec.keywords).items() for v in (lexeme, value_of(kind))))
    string = reduce(lambda a, b: a | b, [x.rlike(f"\\A(?:{p})\\z") for p, _ in spec.strings])
    word, number = F.when(first.rlike("[A-Za-z_$]"), F.lit(value_of("VAR"))), F.when(first.rlike("[0-9]"), F.lit(value_of("NUM")))
    # what most lexemes are comes first: space is nothing, and no string begins with a letter but those with a prefix
    value = F.coalesce(F.element_at(table, x), F.when(string, F.lit(value_of("STR"))), number, word)
    if spec.directives:
        value = F.when(first == "#", F.lit(value_of("INCLUDE"))).otherwise(value)
    return F.when(first.isin(" ", "\n", "\t", "\r"), F.lit(None)).otherwise(value).cast("long")


#: Elements that one inner sum runs over: sums of blocks, and then of their totals, so long arrays aren't copied for each element.
_SUM_BLOCK = 128


def _with_sums(rows: DataFrame, values: str, sums: str) -> DataFrame:
    """rows with the array sums: for each element of values (array<int>) the sum of those before it."""
    n = F.size(values)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / _SUM_BLOCK).cast("int") - 1, F.lit(0)))
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda by: lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + by(v)))
    # a block takes its own span of the array, which is sliced once for each block
    cut = rows.withColumn("_blocks", F.transform(starts, lambda b: F.slice(values, b * _SUM_BLOCK + 1, _SUM_BLOCK)))
    inner = cut.withColumn("_inner", F.transform("_blocks", lambda block: F.aggregate(block, zero, grow(lambda v: v))))
    outer = inner.withColumn("_outer", F.aggregate("_inner", zero, grow(lambda s: F.element_at(s, -1))))
    whole = F.flatten(F.zip_with("_inner", F.slice("_outer", 1, F.size("_inner")), lambda s, o: F.transform(F.slice(s, 1, F.size(s) - 1), lambda v: v + o)))
    return outer.withColumn(sums, whole).drop("_blocks", "_inner", "_outer")


def with_language(submissions: DataFrame, languages: Mapping[str, Language]) -> DataFrame:
    """KEYS, code, language of submissions with code that isn't blank; names that languages doesn't have are resolved by file name and text."""
    given = F.when(F.col("language").isin(*languages), F.col("language")).otherwise(resolve_language(F.col("language"), F.col("code"), F.col("file_name")))
    return submissions.where(F.trim("code") != "").select(*KEYS, "code", given.alias("language"))


def code_values(submissions: DataFrame, languages: Mapping[str, Language] = LANGUAGES, lines: bool = True) -> DataFrame:
    """KEYS, tokens (value, line) of submissions (KEYS, code, language, file_name; one row each): what tokenize_any() gives, as one array in each row with only the hashes of types and the lines; without lines just the values.

    Nothing is shuffled or sorted, and lexemes never become rows.
    """
    rows = with_language(submissions, languages)
    pieces = _by_language(languages, lambda spec: F.regexp_extract_all("code", F.lit(lexeme_pattern(spec)), F.lit(0)))
    cut = rows.select(*KEYS, "language", pieces.alias("lexemes"))
    values = _by_language(languages, lambda spec: F.transform("lexemes", lambda x: _value(spec, x)))
    if not lines:
        return cut.select(*KEYS, F.filter(values, lambda v: v.isNotNull()).alias("tokens"))
    breaks = F.transform("lexemes", lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long"))
    summed = _with_sums(cut.select(*KEYS, values.alias("values"), breaks.alias("breaks")), "breaks", "before")
    both = F.zip_with("values", "before", lambda v, n: F.struct(v.alias("value"), (n + 1).cast("int").alias("line")))
    return summed.select(*KEYS, F.filter(both, lambda t: t["value"].isNotNull()).alias("tokens"))


def prose_words(text: Column) -> Column:
    """Words in lower case and runs of digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(PROSE_PATTERN), F.lit(0))


def prose_tokens(texts: DataFrame) -> DataFrame:
    """KEYS, pos, type, line (always 1) of texts (KEYS, text): words in lower case and runs of digits."""
    return texts.select(*KEYS, F.posexplode(prose_words(F.col("text"))).alias("pos", "type")).withColumn("line", F.lit(1))

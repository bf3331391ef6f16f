"""The language of a file by its name or its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexicons import ALIASES, DEFAULT_LANGUAGE, EXTENSIONS, LANGUAGES, SIGNS


def lookup(table: dict[str, str], key: Column) -> Column:
    """table as an expression; null where it lacks the key."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name without a dot."""
    return F.lower(F.substring_index(name, ".", -1))


def language_from_name(name: Column) -> Column:
    return lookup(EXTENSIONS, extension(name))


def language_from_code(code: Column) -> Column:
    """The first language one of whose signs the text bears."""
    text, chain = F.trim(F.coalesce(code, F.lit(""))), None
    for language, signs in SIGNS:
        any_sign = F.lit(False)
        for conditions in signs:
            every = F.lit(True)
            for c in conditions:
                every = every & (text.contains(c[4:]) if c[:4] == "has:" else ~text.contains(c[4:]) if c[:4] == "not:" else text.rlike(c))
            any_sign = any_sign | every
        chain = F.when(any_sign, language) if chain is None else chain.when(any_sign, language)
    return chain.otherwise(DEFAULT_LANGUAGE)


def detect_language(code: Column, name: Column) -> Column:
    return F.coalesce(language_from_name(name), language_from_code(code))


def resolve_language(language: Column, code: Column, name: Column) -> Column:
    """A language's own name for one of its names; detected for auto, null and unknown names."""
    given = F.lower(F.coalesce(language, F.lit("auto")))
    known = F.coalesce(lookup(ALIASES, given), given)
    return F.when(known.isin(*LANGUAGES), known).otherwise(detect_language(code, name))

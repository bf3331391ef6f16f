"""What the lexers know of each language: keywords, operators, patterns, extensions and signs of a language.

A lexeme is found by one ordered alternation per language that covers the
whole text, so places follow from the lengths of lexemes. Two spellings of
each pattern accept the same texts: Java's with possessive loops, which keep
long literals off the stack, and one without them for other engines.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Language:
    keywords: dict[str, str]  # word: token type
    operators: dict[str, str]  # operator: token type, longer ones before their beginnings
    comments: tuple[str, ...]
    strings: tuple[tuple[str, str], ...]  # pattern, what stands for it in the output ("" for its own text)
    numbers: str
    word: str
    directives: bool = False


def _words(text: str, **others: str) -> dict[str, str]:
    """Keywords whose token type is the word in capitals, and others."""
    return {w: w.upper() for w in text.split()} | others


def _same(words: str, kind: str) -> dict[str, str]:
    return dict.fromkeys(words.split(), kind)


def _ops(text: str, **others: str) -> dict[str, str]:
    """Operators whose token type is themselves; names in others replace it."""
    named = {"FLOOR_DIV": "//", "ARROW_ANNOTATION": "->", "BITWISE_NOT": "~", "AT": "@", "OPTIONAL_CHAIN": "?.", "NULLISH_COALESCE": "??", "STREAM_OUT": "<<", "STREAM_IN": ">>"}
    types = {named[n]: n for n in others.get("named", "").split()} | ({"->": "=>"} if "arrow" in others else {})
    return {op: types.get(op, op) for op in text.split()}


# Keywords and operators of each language with the token types that stand for them.
_SINGLE = "= + - * / % < > . , : ; ( ) [ ] { } & | ^"
_COMPARE = "== != <= >= += -= *= /= %="
PYTHON = Language(
    _words("if else elif for while return def class import from try except finally with as in not and or True False None break continue pass lambda yield raise global is"),
    _ops(f"... ** {_COMPARE} // -> {_SINGLE} ~ @ ?", named="FLOOR_DIV ARROW_ANNOTATION BITWISE_NOT AT"),
    (r"#[^\n]*",),
    ((r'"""[\s\S]*?(?:"""|\z)', "TRIPLE_STRING"), (r"'''[\s\S]*?(?:'''|\z)", "TRIPLE_STRING"), (r'"(?:\\[^\n]|[^"\\\n])*+\\?"?', ""), (r"'(?:\\[^\n]|[^'\\\n])*+\\?'?", "")),
    r"0[xXoObB][0-9a-fA-F_]*|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?",
    r"[A-Za-z_][A-Za-z0-9_]*",
)
_C_COMMENTS = (r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\z)")
_C_STRINGS = ((r'"(?:\\[\s\S]|[^"\\\n])*+\\?"?', "STRING"), (r"'(?:\\[\s\S]|[^'\\\n])*+\\?'?", "STRING"))
_HEX = r"0[xX][0-9a-fA-F_]*|[0-9]+(?:\.[0-9]*)?"
JAVASCRIPT = Language(
    _words(
        "if else for while return function class import from try catch finally throw switch case default const let new this typeof instanceof async await in of true false null undefined break continue do export extends super yield delete void",
        var="VAR_KW",
    ),
    _ops(f"=== !== ... => ** {_COMPARE} && || ?. ?? {_SINGLE} ~ ! ?", named="OPTIONAL_CHAIN NULLISH_COALESCE BITWISE_NOT"),
    _C_COMMENTS,
    ((r"`(?:\\[\s\S]|[^`\\])*+\\?`?", "TEMPLATE"), *_C_STRINGS),
    r"0[xXoObB][0-9a-fA-F_]*|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?n?",
    r"[A-Za-z_$][A-Za-z0-9_$]*",
)
JAVA = Language(
    _words("if else for while do return class public private protected static final void try catch finally throw new this super import switch case default null true false break continue instanceof", throws="THROW", package="IMPORT")
    | _same("interface enum", "CLASS")
    | _same("int double float boolean char long short byte String", "TYPE"),
    _ops(f"... {_COMPARE} && || ++ -- -> {_SINGLE} ! ?", arrow="yes"),
    (*_C_COMMENTS, r"@[A-Za-z0-9_$]*"),
    _C_STRINGS,
    rf"(?:{_HEX})[LfdFD]?",
    r"[A-Za-z_$][A-Za-z0-9_$]*",
)
CPP = Language(
    _words("if else for while do return class struct namespace using typedef public private protected static const void try catch throw new delete this switch case default true false break continue template typename", constexpr="CONST", nullptr="NULL", NULL="NULL")
    | _same("auto int double float bool char long short unsigned signed size_t string vector", "TYPE"),
    _ops(f":: << >> {_COMPARE} && || ++ -- -> {_SINGLE} ! ?", arrow="yes", named="STREAM_OUT STREAM_IN"),
    _C_COMMENTS,
    _C_STRINGS,
    rf"(?:{_HEX})[uUlLfF]?",
    r"[A-Za-z_][A-Za-z0-9_]*",
    True,
)
C = Language(
    _words("if else for while do return struct typedef static const extern void switch case default break continue sizeof", union="STRUCT", enum="CLASS", NULL="NULL") | _same("int double float char long short unsigned signed size_t", "TYPE"),
    _ops(f"{_COMPARE} && || ++ -- -> {_SINGLE} ! ?", arrow="yes"),
    _C_COMMENTS,
    _C_STRINGS,
    rf"(?:{_HEX})[uUlL]?",
    r"[A-Za-z_][A-Za-z0-9_]*",
    True,
)
CSHARP = Language(
    _words("if else for while do return class struct namespace using public private protected static const void try catch finally throw async await new this switch case default null true false break continue typeof is as in", foreach="FOR", interface="CLASS", internal="PRIVATE", var="VAR_KW", base="SUPER")
    | _same("int double float string bool char long short byte object decimal", "TYPE"),
    _ops(f"{_COMPARE} && || ++ -- => ?? ?. {_SINGLE} ! ?", named="OPTIONAL_CHAIN NULLISH_COALESCE"),
    _C_COMMENTS,
    ((r'[@$]?"(?:\\[\s\S]|[^"\\])*+\\?"?', "STRING"), (r"'(?:\\[\s\S]|[^'\\])*+\\?'?", "STRING")),
    rf"(?:{_HEX})[uUlLfFdDmM]?",
    r"[A-Za-z_][A-Za-z0-9_]*",
)
#: Languages by name; another entry makes another language known to all operators.
LANGUAGES = {"python": PYTHON, "javascript": JAVASCRIPT, "java": JAVA, "cpp": CPP, "c": C, "csharp": CSHARP}

# Other names of languages, and extensions.
ALIASES = {"js": "javascript", "ts": "javascript", "typescript": "javascript", "py": "python", "c++": "cpp", "cc": "cpp", "cs": "csharp", "c#": "csharp"}
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h++": "cpp", "c": "c", "h": "c", "cs": "csharp",
}
#: Of uploads: a narrower table, and a bulk upload also takes .txt for Python.
UPLOADS = {"py": "python", "js": "javascript", "jsx": "javascript", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "cs": "csharp"}
BULK_UPLOADS = UPLOADS | {"txt": "python"}

# Signs of a language in a text, tried in this order. A sign is a list of conditions that all hold;
# a condition is a pattern, or a plain text after "has:" or "not:".
SIGNS = (
    ("csharp", ([r"using\s+System(\.[A-Za-z0-9_]+)*\s*;"], [r"Console\.Write(Line)?\s*\("], [r"namespace\s+[A-Za-z0-9_.]+\s*\{"])),
    (
        "cpp",
        (
            [r"#include\s*<(vector|string|map|set|algorithm|iostream|cmath|memory|utility)>"],
            [r"std::(cout|cin|endl|vector|string|map|set)"],
            [r"cout\s*<<"],
            [r"cin\s*>>"],
            [r"using\s+namespace\s+std\s*;"],
            [r"template\s*<"],
        ),
    ),
    ("c", ([r"#include\s*<(stdio|stdlib|string|math|time|assert|stdbool)\.h>"], [r"printf\s*\("], [r"scanf\s*\("])),
    ("java", ([r"(?i:import\s+java\.[a-z0-9_.]+)"], [r"public\s+class\s+[A-Za-z0-9_]+"], [r"public\s+static\s+void\s+main\s*\(\s*String\s*\[\s*\]"], [r"System\.out\.print(ln)?\s*\("])),
    (
        "python",
        (
            [r"def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(.*?\)\s*:"],
            [r"from\s+[a-zA-Z_][a-zA-Z0-9_.]*\s+import"],
            [r"import\s+[a-zA-Z_][a-zA-Z0-9_.]*", "has::"],
            [r"print\s*\(.*?\)", "not:;", "has:def "],
            [r"print\s*\(.*?\)", "not:;", "has:elif "],
        ),
    ),
    ("javascript", ([r"const\s+|let\s+|var\s+"], [r"function\s+[a-zA-Z_]"], [r"=>"], [r"console\.log\s*\("], [r"export\s+(default|const|function|class)"], [r"import\s+.*?\s+from\s+['\"]"])),
    ("cpp", (["has:#include", "has:cout"], ["has:#include", "has:std::"])),
    ("c", (["has:#include"],)),
    ("python", (["has:def "], ["has:elif "])),
    ("java", (["has:public class"],)),
)
DEFAULT_LANGUAGE = "javascript"


def _escaped(op: str) -> str:
    return "".join(f"\\{c}" if c in ".*+?|()[]{}^$/-" else c for c in op)


def lexeme_pattern(language: Language, possessive: bool = True) -> str:
    """The alternation of all lexemes; spaces and single other characters come last."""
    parts = [*language.comments, *(r"#[A-Za-z0-9_]*[^\n]*",) * language.directives, *(p for p, _ in language.strings)]
    parts += [*map(_escaped, language.operators), language.numbers, language.word, r"[ \t\r]+", r"[\s\S]"]
    pattern = "|".join(parts)
    return pattern if possessive else pattern.replace("*+", "*")


#: Prose: words in lower case are the token types.
PROSE_PATTERN = r"\p{L}+|[0-9]+"

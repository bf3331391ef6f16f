"""DuckDB SQL for the shared parts of the registered queries."""

from __future__ import annotations

import re

from ..functions.lexicons import ALIASES, DEFAULT_LANGUAGE, EXTENSIONS, LANGUAGES, SIGNS, lexeme_pattern
from ..sources.programs import FILE_EXTENSIONS, LANGUAGE_NAMES, TEMPLATES


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def case(table: dict, key: str, otherwise: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {text(k) if isinstance(k, str) else k} THEN {text(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def _filled(template: str) -> str:
    pieces = re.split(r"~([KS])~", template)
    return " || ".join({"K": "p_partkey", "S": "p_size"}[p] if i % 2 else text(p) for i, p in enumerate(pieces) if p)


def language_from_name(name: str) -> str:
    return case(EXTENSIONS, f"lower(string_split({name}, '.')[-1])")


def language_from_code(code: str) -> str:
    def sign(conditions):
        return " AND ".join(
            f"contains({code}, {text(c[4:])})" if c[:4] == "has:" else f"NOT contains({code}, {text(c[4:])})" if c[:4] == "not:" else f"regexp_matches({code}, {text(c)})" for c in conditions
        )

    return "CASE " + " ".join(f"WHEN {' OR '.join(f'({sign(s)})' for s in signs)} THEN '{language}'" for language, signs in SIGNS) + f" ELSE '{DEFAULT_LANGUAGE}' END"


def resolve_language(language: str, code: str, name: str) -> str:
    known = case(ALIASES, f"lower(coalesce({language}, 'auto'))", f"lower(coalesce({language}, 'auto'))")
    names = ", ".join(map(text, LANGUAGES))
    return f"CASE WHEN ({known}) IN ({names}) THEN ({known}) ELSE coalesce({language_from_name(name)}, {language_from_code(code)}) END"


_CODE = "CASE (p_partkey % 6) * 3 + (p_partkey // 6) % 3 " + " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(TEMPLATES)) + " END"
_EXT = case(dict(enumerate(FILE_EXTENSIONS)), "p_partkey % 6")
PROGRAMS = f"""
programs AS (SELECT *, row_number() OVER (PARTITION BY assignment_id, student_id ORDER BY submitted_at, submission_id) AS version FROM (
  SELECT p_brand || '/' || {_EXT} AS assignment_id, p_partkey AS submission_id, 'S' || p_size AS student_id, p_name AS student_name,
    CASE WHEN p_partkey % 13 = 0 THEN 'failed' ELSE 'fingerprinted' END AS status, TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 60 + p_size * 7) AS submitted_at,
    {case(dict(enumerate(LANGUAGE_NAMES)), 'p_partkey % 12')} AS language, 'w' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.' || {_EXT} END AS file_name, {_CODE} AS code FROM part)),
latest AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY assignment_id, student_id ORDER BY version DESC, submitted_at DESC, submission_id DESC) AS nth FROM programs WHERE status = 'fingerprinted') WHERE nth = 1)"""


def tokens(source: str = "programs", only: str | None = None) -> str:
    """CTEs up to tok(assignment_id, submission_id, pos, type, original, line, column, start, end) of source."""
    names = [only] if only else list(LANGUAGES)
    parts, kinds = [], []
    for name in names:
        spec, plain = LANGUAGES[name], lexeme_pattern(LANGUAGES[name], False)
        parts.append(f"SELECT assignment_id, submission_id, '{name}' AS lang, regexp_extract_all(code, {text(plain)}) AS l FROM resolved WHERE lang = '{name}' AND trim(code) <> ''")
        kinds += [f"('{name}', {text(x)}, {text(t)})" for x, t in (spec.operators | spec.keywords).items()]
    full = lambda p: f"regexp_full_match(lexeme, {text(p.replace('*+', '*'))})"
    strings = " ".join(f"WHEN lang = '{name}' AND ({' OR '.join(full(p) for p, _ in LANGUAGES[name].strings)}) THEN 'STR'" for name in names)
    original = " ".join(f"WHEN lang = '{name}' AND {full(p)} THEN {text(o) if o else 'lexeme'}" for name in names for p, o in LANGUAGES[name].strings)
    directive = ", ".join(text(n) for n in names if LANGUAGES[n].directives) or "''"
    return f"""
resolved AS (SELECT *, {resolve_language('language', 'code', 'file_name')} AS lang FROM {source}),
kinds(lang, lexeme, type) AS (VALUES {', '.join(kinds)}),
found AS ({' UNION ALL '.join(parts)}),
lex AS (SELECT assignment_id, submission_id, lang, unnest(l) AS lexeme, unnest(range(len(l))) AS i FROM found),
lex1 AS (SELECT *, coalesce(sum(length(lexeme)) OVER w, 0)::BIGINT AS start, coalesce(sum(length(lexeme) - length(replace(lexeme, chr(10), ''))) OVER w, 0) + 1 AS line FROM lex
  WINDOW w AS (PARTITION BY submission_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lex2 AS (SELECT *, start - coalesce(max(CASE WHEN contains(lexeme, chr(10)) THEN start + length(lexeme) - length(string_split(lexeme, chr(10))[-1]) END) OVER (PARTITION BY submission_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM lex1),
lex3 AS (SELECT x.*, CASE WHEN x.lang IN ({directive}) AND lexeme[1] = '#' THEN 'INCLUDE' WHEN k.type IS NOT NULL THEN k.type {strings}
  WHEN regexp_matches(lexeme, '^[0-9]') THEN 'NUM' WHEN regexp_matches(lexeme, '^[A-Za-z_$]') THEN 'VAR' END AS type FROM lex2 x LEFT JOIN kinds k USING (lang, lexeme)),
tok AS (SELECT assignment_id, submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY i) - 1 AS pos, type,
  CASE WHEN type = 'INCLUDE' AND lexeme[1] = '#' THEN regexp_extract(lexeme, '^(#[A-Za-z0-9_]*)', 1) {original} ELSE lexeme END AS original,
  line::INT AS line, col::INT AS "column", start, start + length(lexeme) AS "end" FROM lex3 WHERE type IS NOT NULL)"""


PROSE = r"""
prose AS (SELECT source AS assignment_id, doc_id AS submission_id, text FROM documents),
tok AS (SELECT assignment_id, submission_id, unnest(l) AS type, unnest(range(len(l))) AS pos, 1 AS line FROM (SELECT *, regexp_extract_all(lower(text), '\p{L}+|[0-9]+') AS l FROM prose))"""


def prints(k: int = 5, w: int = 4) -> str:
    """CTEs from tok to grams, fps(assignment_id, submission_id, hash, pos, start_line, end_line), sets and sizes."""
    ahead = ", ".join(f"lead(v, {j}) OVER o AS v{j}" for j in range(1, k))
    horner = "v % 1000000007"
    for j in range(1, k):
        horner = f"(({horner}) * 31 + v{j}) % 1000000007"
    return f"""
voc AS (SELECT type, CASE WHEN type = '' THEN 0 ELSE list_reduce(list_prepend(0::BIGINT, list_transform(string_split(type, ''), lambda x: unicode(x)::BIGINT)), lambda a, c: (a * 31 + c) % 1000000007) END AS v FROM (SELECT DISTINCT type FROM tok)),
val AS (SELECT assignment_id, submission_id, pos, line, v FROM tok JOIN voc USING (type)),
led AS (SELECT *, {ahead}, lead(line, {k - 1}) OVER o AS end_line FROM val WINDOW o AS (PARTITION BY submission_id ORDER BY pos)),
grams AS (SELECT assignment_id, submission_id, {horner} AS hash, pos, line AS start_line, end_line FROM led WHERE end_line IS NOT NULL),
win AS (SELECT assignment_id, submission_id, min({{'h': hash, 'back': -pos, 's': start_line, 'e': end_line}}) OVER (PARTITION BY submission_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m,
  row_number() OVER (PARTITION BY submission_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY submission_id) AS n FROM grams),
fps AS (SELECT DISTINCT assignment_id, submission_id, m.h AS hash, -m.back AS pos, m.s AS start_line, m.e AS end_line FROM win WHERE nth <= greatest(n - {w - 1}, 1)),
sets AS (SELECT DISTINCT assignment_id, submission_id, hash FROM fps),
sizes AS (SELECT assignment_id, submission_id, count(*) AS size FROM sets GROUP BY ALL)"""


SHARED = """
common AS (SELECT x.assignment_id, x.submission_id AS a, y.submission_id AS b, hash FROM sets x JOIN sets y USING (assignment_id, hash) WHERE x.submission_id < y.submission_id),
cand AS (SELECT assignment_id, a, b, count(*) AS shared FROM common GROUP BY ALL)"""


def stats(source: str, threshold: float = 0.7, starter: str | None = None) -> str:
    """CTE stats(assignment_id, hash, occurrences, total, frequency, is_boilerplate); starter: SELECT of hashes."""
    known = f" OR hash IN ({starter})" if starter else ""
    return f"""
stats AS (SELECT *, (total >= 3 AND occurrences >= greatest(3, ceil(total::DOUBLE * {threshold}::DOUBLE))){known} AS is_boilerplate FROM (
  SELECT assignment_id, hash, count(*) AS occurrences, any_value(total) AS total, count(*)::DOUBLE / any_value(total) AS frequency
  FROM sets JOIN (SELECT assignment_id, count(*) AS total FROM {source} GROUP BY ALL) USING (assignment_id) GROUP BY ALL))"""


ADJUSTED = """
flagged AS (SELECT sets.*, is_boilerplate FROM sets JOIN stats USING (assignment_id, hash)),
clean AS (SELECT assignment_id, submission_id, count(*) FILTER (NOT is_boilerplate) AS clean, count(*) AS size FROM flagged GROUP BY ALL),
counted AS (SELECT assignment_id, a, b, count(*) AS shared, count(*) FILTER (is_boilerplate) AS n_boilerplate FROM common JOIN stats USING (assignment_id, hash) GROUP BY ALL),
adj AS (SELECT c.assignment_id, a, b, shared, shared::DOUBLE / (x.size + y.size - shared) AS raw,
  CASE WHEN x.clean + y.clean - (shared - n_boilerplate) = 0 THEN 0.0::DOUBLE ELSE (shared - n_boilerplate)::DOUBLE / (x.clean + y.clean - (shared - n_boilerplate)) END AS adjusted,
  n_boilerplate::DOUBLE / (x.size + y.size - shared) AS overlap, n_boilerplate, shared - n_boilerplate AS n_clean
  FROM counted c JOIN clean x ON x.assignment_id = c.assignment_id AND x.submission_id = a JOIN clean y ON y.assignment_id = c.assignment_id AND y.submission_id = b)"""

REGIONS = """
firsts AS (SELECT assignment_id, submission_id, hash, min_by({'s': start_line, 'e': end_line}, pos) AS at_ FROM fps GROUP BY ALL),
raws AS (SELECT x.assignment_id, x.submission_id AS a, y.submission_id AS b, hash, x.at_.s::INT AS sa, y.at_.s::INT AS sb, x.at_.e::INT AS ea, y.at_.e::INT AS eb FROM firsts x JOIN firsts y USING (assignment_id, hash) WHERE x.submission_id < y.submission_id),
nth AS (SELECT *, row_number() OVER (PARTITION BY assignment_id, a, b ORDER BY sa, sb, ea, eb) AS i FROM raws),
fold AS (SELECT assignment_id, a, b, i, sa, sb, ea, eb, 1 AS n, 1 AS region FROM nth WHERE i = 1
  UNION ALL SELECT f.assignment_id, f.a, f.b, c.i,
    CASE WHEN near THEN f.sa ELSE c.sa END, CASE WHEN near THEN f.sb ELSE c.sb END, CASE WHEN near THEN greatest(f.ea, c.ea) ELSE c.ea END, CASE WHEN near THEN greatest(f.eb, c.eb) ELSE c.eb END,
    CASE WHEN near THEN f.n + 1 ELSE 1 END, CASE WHEN near THEN f.region ELSE f.region + 1 END
  FROM fold f JOIN nth c ON c.assignment_id = f.assignment_id AND c.a = f.a AND c.b = f.b AND c.i = f.i + 1, LATERAL (SELECT c.sa <= f.ea + 2 AND c.sb <= f.eb + 2 AS near)),
regions AS (SELECT assignment_id, a, b, region, last(sa ORDER BY i) AS sa, last(sb ORDER BY i) AS sb, last(ea ORDER BY i) AS ea, last(eb ORDER BY i) AS eb, last(n ORDER BY i) AS n FROM fold GROUP BY assignment_id, a, b, region),
folded AS (SELECT assignment_id, a, b, list({'sa': sa, 'sb': sb, 'ea': ea, 'eb': eb, 'n': n} ORDER BY region) AS regions, count(*) AS n_regions,
  len(list_distinct(flatten(list(range(sa, ea + 1)))))::BIGINT AS lines_a, len(list_distinct(flatten(list(range(sb, eb + 1)))))::BIGINT AS lines_b FROM regions GROUP BY assignment_id, a, b)"""


#: CTEs from adj and latest to ops(assignment_id, a, b, op_no, type, a_start, a_end, b_start, b_end): a longest common subsequence by its table, row by row, and back from the end.
DIFF = """
sides AS (SELECT adj.assignment_id, a, b, list_transform(string_split(p.code, chr(10)), lambda s: trim(s)) AS x0, list_transform(string_split(q.code, chr(10)), lambda s: trim(s)) AS y0 FROM adj JOIN latest p ON p.submission_id = a JOIN latest q ON q.submission_id = b),
rest AS (SELECT assignment_id, a, b, p, x0[p + 1:] AS x, y0[p + 1:] AS y, len(x0) AS n, len(y0) AS m FROM (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(x0), len(y0)) + 1), lambda k: x0[k] <> y0[k])) - 1, least(len(x0), len(y0))) AS p FROM sides)),
dp(a, b, i, t) AS (SELECT a, b, 0, [list_transform(range(len(y) + 1), lambda k: 0::BIGINT)] FROM rest
  UNION ALL SELECT a, b, i + 1, list_append(t, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(y) + 1), lambda j: [j])),
    lambda done, j: list_append(done, CASE WHEN x[i + 1] = y[j[1]] THEN t[i + 1][j[1]] + 1 ELSE greatest(t[i + 1][j[1] + 1], done[len(done)]) END)))
  FROM dp JOIN rest USING (a, b) WHERE i < len(x)),
tables AS (SELECT a, b, x, y, t FROM dp JOIN rest USING (a, b) WHERE i = len(x)),
back(a, b, i, j, hit) AS (SELECT a, b, len(x), len(y), false FROM rest
  UNION ALL SELECT a, b, CASE WHEN x[i] = y[j] OR t[i][j + 1] = t[i + 1][j + 1] THEN i - 1 ELSE i END, CASE WHEN x[i] = y[j] OR t[i][j + 1] <> t[i + 1][j + 1] THEN j - 1 ELSE j END, x[i] = y[j]
  FROM back JOIN tables USING (a, b) WHERE i > 0 AND j > 0),
hits AS (SELECT a, b, i + p AS i, j + p AS j FROM back JOIN rest USING (a, b) WHERE hit UNION ALL SELECT a, b, k, k FROM (SELECT a, b, unnest(range(p)) AS k FROM rest)),
runs AS (SELECT *, sum(CASE WHEN i = last_i + 1 AND j = last_j + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY a, b ORDER BY i) AS run FROM (
  SELECT *, lag(i) OVER w AS last_i, lag(j) OVER w AS last_j FROM hits WINDOW w AS (PARTITION BY a, b ORDER BY i))),
spans AS (SELECT *, lag(ei, 1, -1) OVER w AS pi, lag(ej, 1, -1) OVER w AS pj FROM (
  SELECT a, b, min(i) AS si, max(i) AS ei, min(j) AS sj, max(j) AS ej FROM runs GROUP BY a, b, run UNION ALL SELECT a, b, n, NULL, m, NULL FROM rest) WINDOW w AS (PARTITION BY a, b ORDER BY si, sj)),
pieces AS (SELECT a, b, si, sj, 1 AS part, 'equal' AS type, si + 1 AS a_start, ei + 1 AS a_end, sj + 1 AS b_start, ej + 1 AS b_end FROM spans WHERE ei IS NOT NULL
  UNION ALL SELECT a, b, si, sj, 0, CASE WHEN si > pi + 1 AND sj > pj + 1 THEN 'modify' WHEN si > pi + 1 THEN 'delete' ELSE 'insert' END,
    CASE WHEN si > pi + 1 THEN pi + 2 END, CASE WHEN si > pi + 1 THEN si END, CASE WHEN sj > pj + 1 THEN pj + 2 END, CASE WHEN sj > pj + 1 THEN sj END FROM spans WHERE si > pi + 1 OR sj > pj + 1),
ops AS (SELECT assignment_id, a, b, (row_number() OVER (PARTITION BY a, b ORDER BY si, sj, part) - 1)::INT AS op_no, type, a_start::INT AS a_start, a_end::INT AS a_end, b_start::INT AS b_start, b_end::INT AS b_end FROM pieces JOIN rest USING (a, b))"""

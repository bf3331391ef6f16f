"""Every registered query of the library, and the DuckDB SQL it is checked against.

Each query reads whole tables; the bindings of the domain to the tables are in
sources.programs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import token_value
from ..functions.lexicons import BULK_UPLOADS, LANGUAGES, UPLOADS
from ..operators import boilerplate as bp
from ..operators import clusters as cl
from ..operators import diff as df_
from ..operators import evidence as ev
from ..operators import fingerprint as fp
from ..operators import intake as it
from ..operators import language as lg
from ..operators import pairs as pr
from ..operators import reports as rp
from ..operators import tokens as tk
from ..operators import versions as vs
from ..sources import ingest as ig
from ..sources import programs as src
from ..sources.durable import kept, spread
from ..streaming import jobs as st
from . import sql as S
from .registry import _QUERIES, _SQL, Query, query

def queries() -> dict[str, Query]:
    from . import report_queries, stream_queries  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# What many queries begin with.

CODE = f"WITH RECURSIVE {S.PROGRAMS}, {S.tokens()}, {S.prints()}, {S.SHARED}"
LATEST = f"WITH RECURSIVE {S.PROGRAMS}, {S.tokens('latest')}, {S.prints()}, {S.SHARED}, {S.stats('latest')}, {S.ADJUSTED}, {S.REGIONS}"
PROSE = f"WITH RECURSIVE {S.PROSE}, {S.prints()}, {S.SHARED}"
NOW = "TIMESTAMP '1998-06-01 05:00:00'"


def _programs(spark, sf):
    return src.programs(spark, sf)


def _tokens_of(programs):
    return kept(tk.tokenize_any(programs))


def _code_tokens(spark, sf):
    """Tokens that one step alone reads, which aren't written out for it."""
    return tk.tokenize_any(_programs(spark, sf))


def _sets_of(programs):
    return kept(fp.code_sets(programs))


def _code_sets(spark, sf):
    return _sets_of(_programs(spark, sf))


def _code_arrays(spark, sf):
    """As _code_sets(), each set as an array of its row, for steps that take either."""
    return fp.code_arrays(_programs(spark, sf))


def _prose_prints(spark, sf):
    return fp.prose_fingerprints(src.prose(spark, sf))


def _prose_sets(spark, sf):
    return fp.prose_sets(src.prose(spark, sf))


def _prose_arrays(spark, sf):
    return fp.prose_arrays(src.prose(spark, sf))


def _latest(spark, sf):
    """The latest programs; a query computes them once, and all that comes of them from this one table."""
    return kept(vs.latest_version(_programs(spark, sf)))


def _prints_of(programs):
    return kept(fp.code_fingerprints(programs))


def _latest_prints(spark, sf):
    return _prints_of(_latest(spark, sf))


def _stats_of(sets, programs):
    return kept(bp.boilerplate_stats(bp.hash_frequency(sets, programs)))


def _results_of(latest, sets=None):
    """Scored pairs of the latest programs, the results that reports go over."""
    sets = _sets_of(latest) if sets is None else sets
    return kept(bp.adjusted_pairs(sets, _stats_of(sets, latest)))


def _results(spark, sf):
    return _results_of(_latest(spark, sf))


# The flagship: pairs of documents of one source that share much of their text.


@query(f"{PROSE} SELECT c.assignment_id, a, b, shared, shared::DOUBLE / (x.size + y.size - shared) AS score, CASE WHEN shared >= 0.7::DOUBLE * (x.size + y.size - shared) THEN 'high' WHEN shared >= 0.4::DOUBLE * (x.size + y.size - shared) THEN 'medium' ELSE 'low' END AS risk FROM cand c JOIN sizes x ON x.submission_id = a JOIN sizes y ON y.submission_id = b")
def suspicious_pairs(spark, sf):
    scored = pr.jaccard(pr.pair_counts(_prose_arrays(spark, sf)))
    return scored.select("assignment_id", "a", "b", F.col("intersection").alias("shared"), "score", ev.risk_level(F.col("score")).alias("risk"))


# Sources


@query(f"WITH {S.PROGRAMS} SELECT submission_id, student_id, version, submitted_at, row_number() OVER (ORDER BY version DESC, submitted_at DESC, submission_id DESC) AS place FROM programs WHERE assignment_id = 'Brand#1/py'")
def scan_cohort(spark, sf):
    from pyspark.sql.window import Window

    one = _programs(spark, sf).where("assignment_id = 'Brand#1/py'")
    place = F.row_number().over(Window.partitionBy("assignment_id").orderBy(F.desc("version"), F.desc("submitted_at"), F.desc("submission_id")))
    return one.select("submission_id", "student_id", "version", "submitted_at", place.alias("place"))


@query(f"WITH {S.PROGRAMS} SELECT * FROM programs")
def synthetic_cohort(spark, sf):
    return _programs(spark, sf)


def _files(spark, sf):
    some = F.concat("assignment_id", F.lit("#"), F.floor(F.col("submission_id") / 100).cast("string"))
    return _programs(spark, sf).select(F.concat("assignment_id", F.lit("/"), "file_name").alias("path"), F.encode("code", "UTF-8").alias("content"), some.alias("archive"))


_UPLOAD = f"lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1))"
_INGESTED = f"SELECT path, string_split(path, '/')[-1] AS file_name, {_UPLOAD} AS ext, {S.case(BULK_UPLOADS, _UPLOAD)} AS language, code FROM files WHERE {S.case(BULK_UPLOADS, _UPLOAD)} IS NOT NULL"


@query(f"WITH {S.PROGRAMS}, files AS (SELECT assignment_id || '/' || file_name AS path, code FROM programs) {_INGESTED}")
def ingest_files(spark, sf):
    return ig.ingest_files(_files(spark, sf))


@query(f"WITH {S.PROGRAMS}, files AS (SELECT assignment_id || '#' || (submission_id // 100) || '!' || assignment_id || '/' || file_name AS path, code FROM programs) {_INGESTED}")
def ingest_zip(spark, sf):
    return ig.ingest_archives(ig.zip_files(_files(spark, sf)))


def _csv_lines(spark, sf):
    key = F.col("c_custkey")
    two = F.concat(key.cast("string"), F.lit(" , W"), (key % 50).cast("string"), F.lit(".py"))
    three = F.concat(key.cast("string"), F.lit(","), "c_name", F.lit(" ,w"), (key % 70).cast("string"), F.lit(".PY"))
    line = F.when(key % 10 == 0, F.lit("Student_ID,name,filename")).when(key % 10 == 1, F.lit("  ")).when(key % 3 == 0, two).otherwise(three)
    return src.read_table(spark, sf, "customer").select(key.alias("line_no"), line.alias("line"))


_CSV = """
lines AS (SELECT c_custkey AS line_no, CASE WHEN c_custkey % 10 = 0 THEN 'Student_ID,name,filename' WHEN c_custkey % 10 = 1 THEN '  ' WHEN c_custkey % 3 = 0 THEN c_custkey || ' , W' || c_custkey % 50 || '.py'
  ELSE c_custkey || ',' || c_name || ' ,w' || c_custkey % 70 || '.PY' END AS line FROM customer),
split AS (SELECT line_no, list_transform(string_split(trim(line), ','), lambda x: trim(x)) AS p FROM lines WHERE trim(line) <> '' AND NOT starts_with(lower(trim(line)), 'student_id')),
mapping AS (SELECT lower(CASE WHEN len(p) >= 3 THEN p[3] ELSE p[2] END) AS file_name, max_by(p[1], line_no) AS student_id, max_by(CASE WHEN len(p) >= 3 THEN p[2] ELSE p[1] END, line_no) AS student_name FROM split WHERE len(p) >= 2 GROUP BY 1)"""


@query(f"WITH {_CSV} SELECT * FROM mapping WHERE file_name <> ''")
def csv_mapping(spark, sf):
    return ig.csv_mapping(_csv_lines(spark, sf))


@query(f"""WITH {S.PROGRAMS}, {_CSV} SELECT assignment_id || '/' || p.file_name AS path, coalesce(m.student_id, regexp_replace(p.file_name, '^(.+)\\.[^.]*$', '\\1')) AS student_id,
  coalesce(m.student_name, regexp_replace(p.file_name, '^(.+)\\.[^.]*$', '\\1')) AS student_name FROM programs p LEFT JOIN mapping m ON m.file_name = lower(p.file_name)""")
def identify_student(spark, sf):
    return ig.identify_students(_files(spark, sf).select("path"), ig.csv_mapping(_csv_lines(spark, sf)))


# Intake


@query(f"WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS submission_id, l_partkey, ['py', 'js', 'JAVA', 'txt', 'md'][l_partkey % 5 + 1] AS e FROM lineitem) SELECT submission_id, {S.case(BULK_UPLOADS, 'lower(e)')} AS bulk, {S.case(UPLOADS, 'lower(e)')} AS single FROM h")
def ext_language(spark, sf):
    return src.handins(spark, sf).select("submission_id", it.ext_language(F.col("file_name")).alias("bulk"), it.ext_language(F.col("file_name"), False).alias("single"))


@query(f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS submission_id, lower(['py', 'js', 'JAVA', 'txt', 'md'][l_partkey % 5 + 1]) AS e, CASE WHEN l_linenumber = 3 THEN '  ' ELSE 'x' END AS code, ['python', 'javascript', 'java', 'auto'][l_orderkey % 4 + 1] AS allowed FROM lineitem)
SELECT submission_id, CASE WHEN {S.case(UPLOADS, 'e')} IS NULL THEN 'extension' WHEN trim(code) = '' THEN 'blank' WHEN allowed <> 'auto' AND {S.case(UPLOADS, 'e')} <> allowed THEN 'language' END AS reason FROM x""")
def accept_filter(spark, sf):
    code = F.when(F.col("submission_id") % 10 == 3, "  ").otherwise(F.col("file_name"))
    files = src.handins(spark, sf).withColumn("code", code).join(src.assignments(spark, sf), "assignment_id")
    return files.select("submission_id", it.reject_reason(F.col("file_name"), F.col("code"), F.col("language_allowed")).alias("reason"))


_DEADLINE = "o_orderdate + INTERVAL 30 DAY + to_hours(o_orderkey % 24)"


@query(f"SELECT l_orderkey AS assignment_id, l_orderkey * 10 + l_linenumber AS submission_id, l_shipdate < {_DEADLINE} AS accepted FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def deadline_filter(spark, sf):
    return vs.deadline_filter(src.handins(spark, sf), src.assignments(spark, sf)).select("assignment_id", "submission_id", "accepted")


#: Tasks that a nation's students are dealt over; its targets go to each of them.
_SLICES = 16


def _groups(spark, sf):
    """Customers as students and suppliers as targets; keys of either choose what is missing or spelt otherwise."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    student = src.read_table(spark, sf, "customer").select(c.alias("student_id"), F.col("c_nationkey").alias("nation"), F.when(c % 3 == 0, F.lit(None)).when(c % 3 == 1, "cse").otherwise("IT").alias("d1"), F.when(c % 5 == 0, " D3").alias("v1"), F.when(c % 7 == 0, "2024").alias("b1"))
    target = src.read_table(spark, sf, "supplier").select(s.alias("assignment_id"), F.col("s_nationkey").alias("nation"), F.when(s % 4 == 0, "it").when(s % 4 == 1, "Cse").alias("d2"), F.when(s % 6 == 0, "d3").alias("v2"), F.lit(None).cast("string").alias("b2"), (s % 9 != 0).alias("has_target"))
    side = lambda n: {"department": F.col(f"d{n}"), "division": F.col(f"v{n}"), "batch": F.col(f"b{n}")}
    student = student.select("student_id", "nation", F.pmod(F.xxhash64("student_id"), F.lit(_SLICES)).alias("slice"), *(c.alias(f"{k}_1") for k, c in it.group_names(side(1)).items()))
    target = target.select("assignment_id", "nation", "has_target", F.expr(f"explode(sequence(0L, {_SLICES - 1}L))").alias("slice"), *(c.alias(f"{k}_2") for k, c in it.group_names(side(2)).items()))
    return spread(student, "nation", "slice").join(spread(target, "nation", "slice").hint("shuffle_hash"), ["nation", "slice"])


@query("""WITH x AS (SELECT c_custkey AS student_id, s_suppkey AS assignment_id, CASE c_custkey % 3 WHEN 1 THEN 'cse' WHEN 2 THEN 'IT' END AS d1, CASE WHEN c_custkey % 5 = 0 THEN ' D3' END AS v1, CASE WHEN c_custkey % 7 = 0 THEN '2024' END AS b1,
  CASE s_suppkey % 4 WHEN 0 THEN 'it' WHEN 1 THEN 'Cse' END AS d2, CASE WHEN s_suppkey % 6 = 0 THEN 'd3' END AS v2, s_suppkey % 9 <> 0 AS has FROM customer JOIN supplier ON s_nationkey = c_nationkey)
SELECT student_id, assignment_id, NOT has OR (upper(coalesce(d1, 'CSE')) = upper(coalesce(d2, 'CSE')) AND trim(upper(coalesce(v1, 'D3'))) = upper(coalesce(v2, 'D3')) AND coalesce(b1, '2023') = '2023') AS matches FROM x""")
def group_match(spark, sf):
    side = lambda n: {key: F.col(f"{key}_{n}") for key in it.GROUP}
    return _groups(spark, sf).select("student_id", "assignment_id", it.same_group(side(1), side(2), F.col("has_target")).alias("matches"))


@query(f"SELECT o_orderkey AS assignment_id, o_orderpriority || ' task ' || o_orderkey AS title, {_DEADLINE} AS deadline, ['python', 'javascript', 'java', 'auto'][o_orderkey % 4 + 1] AS language_allowed, {NOW} >= {_DEADLINE} AS is_closed FROM orders")
def safe_view(spark, sf):
    return src.assignments(spark, sf).select("assignment_id", "title", "deadline", "language_allowed", (F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")) >= F.col("deadline")).alias("is_closed"))


@query(r"""WITH RECURSIVE c AS (SELECT c_custkey, upper(regexp_replace(CASE WHEN c_custkey % 9 = 0 THEN '- ! x' ELSE c_mktsegment || ' ' || c_name END, '[^a-zA-Z0-9]', '', 'g'))[1:4] AS p, (c_custkey * 7919) % 9000 + 1000 AS n FROM customer),
d(k, n, s) AS (SELECT c_custkey, n, '' FROM c UNION ALL SELECT k, n // 36, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[n % 36 + 1] || s FROM d WHERE n > 0)
SELECT c_custkey, CASE WHEN length(p) < 2 THEN 'CODE' ELSE p END || '-' || lpad(s, 4, 'X') AS code FROM c JOIN d ON k = c_custkey AND d.n = 0""")
def assignment_code(spark, sf):
    title = F.when(F.col("c_custkey") % 9 == 0, "- ! x").otherwise(F.concat("c_mktsegment", F.lit(" "), "c_name"))
    return src.read_table(spark, sf, "customer").select("c_custkey", it.assignment_code(title, F.col("c_custkey")).alias("code"))


@query("SELECT p.p_partkey, o.p_partkey AS asked FROM part p JOIN (SELECT p_partkey, '  ' || lower(p_name) || '-' || p_partkey || ' ' AS q FROM part) o ON upper(trim(q)) = upper(p_name || '-' || p.p_partkey)")
def code_lookup(spark, sf):
    part = src.read_table(spark, sf, "part")
    codes = part.select("p_partkey", F.upper(F.concat("p_name", F.lit("-"), "p_partkey")).alias("code"))
    asked = part.select(F.col("p_partkey").alias("asked"), it.code_key(F.concat(F.lit("  "), F.lower("p_name"), F.lit("-"), "p_partkey", F.lit(" "))).alias("code"))
    return codes.join(asked, "code").select("p_partkey", "asked")


def _entries(spark, sf):
    key = F.col("p_partkey")
    shape = F.when(key % 5 == 0, F.concat(F.lit("../"), "p_name")).when(key % 5 == 1, F.concat(F.lit("__MACOSX/"), "p_name")).when(key % 5 == 2, F.concat(F.lit("a\\..\\"), "p_name")).when(key % 5 == 3, F.concat(F.lit("src/.hid"), "p_name"))
    return src.read_table(spark, sf, "part").select("p_partkey", shape.otherwise(F.concat(F.lit("src/"), "p_name", F.lit(".py"))).alias("path"))


@query(r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '../' || p_name WHEN 1 THEN '__MACOSX/' || p_name WHEN 2 THEN 'a\..\' || p_name WHEN 3 THEN 'src/.hid' || p_name ELSE 'src/' || p_name || '.py' END AS path FROM part)
SELECT p_partkey, path <> '' AND NOT contains(replace(path, '\', '/'), '../') AND NOT starts_with(path, '__MACOSX') AND NOT contains(path, '/.') AS safe FROM x""")
def safe_path(spark, sf):
    return _entries(spark, sf).select("p_partkey", it.safe_path(F.col("path")).alias("safe"))


@query(f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority || repeat('x', (o_orderkey % 300)::INT) END AS title, CASE o_orderkey % 7 WHEN 0 THEN 'cobol' ELSE 'python' END AS lang,
  CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime({_DEADLINE}, '%Y-%m-%d %H:%M:%S') END AS deadline, (o_orderkey % 15 - 2)::DOUBLE / 10 AS threshold, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_custkey || '@b.org' ELSE 'a@b' END AS email, repeat('c', (o_orderkey % 25)::INT) AS code FROM orders),
t AS (SELECT *, try_cast(deadline AS TIMESTAMP) AS d FROM x)
SELECT id, array_to_string(list_filter([CASE WHEN NOT length(title) BETWEEN 1 AND 200 THEN 'title:length' END, CASE WHEN lang = 'cobol' THEN 'language_allowed:enum' END, CASE WHEN d IS NULL THEN 'deadline:date' END, CASE WHEN d <= {NOW} THEN 'deadline:future' END,
  CASE WHEN NOT threshold BETWEEN 0 AND 1 THEN 'threshold:range' END, CASE WHEN length(code) > 20 THEN 'assignment_code:length' END, CASE WHEN NOT regexp_matches(email, '{it.EMAIL}') THEN 'email:format' END], lambda x: x IS NOT NULL), ',') AS errors FROM t""")
def validate_rows(spark, sf):
    key = F.col("assignment_id")
    rows = src.assignments(spark, sf).join(src.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("assignment_id"), "o_orderpriority"), "assignment_id")
    rows = rows.select(
        key.alias("id"), F.when(key % 11 == 0, "").otherwise(F.concat("o_orderpriority", F.repeat(F.lit("x"), (key % 300).cast("int")))).alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(key % 7 == 0, "cobol").otherwise("python").alias("language_allowed"), F.when(key % 13 == 0, "soon").otherwise(F.date_format("deadline", "yyyy-MM-dd HH:mm:ss")).alias("deadline"),
        ((key % 15 - 2) / 10).alias("threshold"), F.repeat(F.lit("c"), (key % 25).cast("int")).alias("assignment_code"), F.when(key % 3 == 0, F.concat(F.lit("a"), "owner_id", F.lit("@b.org"))).otherwise("a@b").alias("email"),
    )
    return it.validate(rows, F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id", "errors")


_LEFT = f"floor((epoch_us({_DEADLINE}) - epoch_us({NOW})) / 60000000)::BIGINT"


@query(f"""WITH x AS (SELECT o_orderkey AS assignment_id, {NOW} >= {_DEADLINE} AS closed, {_LEFT} AS m FROM orders)
SELECT assignment_id, CASE WHEN closed THEN 'Closed' WHEN m // 1440 > 1 THEN 'Due in ' || m // 1440 || ' days' WHEN m // 1440 = 1 THEN 'Due in 1 day' WHEN m // 60 >= 2 THEN 'Due in ' || m // 60 || ' hours' WHEN m // 60 >= 1 THEN 'Due in 1 hour' ELSE 'Due in ' || greatest(1, m) || ' minutes' END AS badge FROM x""")
def due_badge(spark, sf):
    return src.assignments(spark, sf).select("assignment_id", rp.due_badge(F.col("deadline"), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).alias("badge"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) > 512000 AS too_big, len(string_split(coalesce(text, ''), chr(10))) * 2 > 2000 OR length(coalesce(text, '')) * 2 > 100000 AS large FROM documents")
def size_guard(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return src.read_table(spark, sf, "documents").select("doc_id", it.size_guard(text, text).alias("g")).select("doc_id", "g.*")


# Languages and tokens


@query(f"WITH {S.PROGRAMS} SELECT submission_id, {S.language_from_name('file_name')} AS language FROM programs")
def lang_from_ext(spark, sf):
    return _programs(spark, sf).select("submission_id", lg.language_from_name(F.col("file_name")).alias("language"))


@query(f"WITH {S.PROGRAMS} SELECT submission_id, {S.language_from_code('code')} AS language FROM programs")
def lang_from_code(spark, sf):
    return _programs(spark, sf).select("submission_id", lg.language_from_code(F.col("code")).alias("language"))


@query(f"WITH {S.PROGRAMS} SELECT submission_id, coalesce({S.language_from_name('file_name')}, {S.language_from_code('code')}) AS language FROM programs")
def detect_language(spark, sf):
    return _programs(spark, sf).select("submission_id", lg.detect_language(F.col("code"), F.col("file_name")).alias("language"))


def _one_language(name: str) -> Query:
    def run(spark, sf):
        own = _programs(spark, sf).where(lg.resolve_language(F.col("language"), F.col("code"), F.col("file_name")) == name)
        return tk.tokenize(own, name).select("submission_id", "pos", "type", "original", "line", "column")

    return run


for _name in LANGUAGES:
    query(f'WITH {S.PROGRAMS}, {S.tokens(only=_name)} SELECT submission_id, pos, type, original, line, "column" FROM tok', f"tokens_{_name}")(_one_language(_name))


@query(f'WITH {S.PROGRAMS}, {S.tokens()} SELECT submission_id, pos, type, original, line, "column" FROM tok')
def tokens_any(spark, sf):
    return _code_tokens(spark, sf).select("submission_id", "pos", "type", "original", "line", "column")


@query(f'WITH {S.PROGRAMS}, {S.tokens()} SELECT submission_id, pos, start, "end" FROM tok')
def token_offsets(spark, sf):
    return _code_tokens(spark, sf).select("submission_id", "pos", "start", "end")


@query(f"WITH {S.PROSE} SELECT submission_id, pos, type FROM tok")
def tokens_text(spark, sf):
    return tk.prose_tokens(src.prose(spark, sf)).select("submission_id", "pos", "type")


# Fingerprints


@query(f"WITH {S.PROGRAMS}, {S.tokens()}, x AS (SELECT submission_id, pos, [type, lead(type) OVER w, lead(type, 2) OVER w, lead(type, 3) OVER w, lead(type, 4) OVER w] AS kgram, lead(pos, 4) OVER w AS last FROM tok WINDOW w AS (PARTITION BY submission_id ORDER BY pos)) SELECT submission_id, pos, array_to_string(kgram, ' ') AS kgram FROM x WHERE last IS NOT NULL")
def kgrams(spark, sf):
    return fp.kgrams(_code_tokens(spark, sf)).select("submission_id", "pos", F.array_join("kgram", " ").alias("kgram"))


@query(f"WITH {S.PROSE}, {S.prints()} SELECT type, v AS value FROM voc")
def token_hash(spark, sf):
    return tk.prose_tokens(src.prose(spark, sf)).select("type").distinct().select("type", token_value(F.col("type")).alias("value"))


@query(f"{CODE} SELECT submission_id, pos, hash FROM grams")
def kgram_hash(spark, sf):
    return fp.kgram_hashes(_code_tokens(spark, sf)).select("submission_id", "pos", "hash")


@query(f"{CODE} SELECT submission_id, pos, hash FROM fps")
def winnow(spark, sf):
    return fp.winnow(fp.kgram_hashes(_code_tokens(spark, sf))).select("submission_id", "pos", "hash")


@query(f"{PROSE} SELECT assignment_id, submission_id, hash, pos, start_line, end_line FROM fps")
def fingerprints(spark, sf):
    return _prose_prints(spark, sf)


@query(f"{CODE} SELECT assignment_id, submission_id, hash, pos, start_line, end_line FROM fps")
def code_fingerprints(spark, sf):
    return fp.code_fingerprints(_programs(spark, sf))


_COUNTS = """p.assignment_id, p.submission_id, coalesce(t.n, 0) AS n_tokens, coalesce(g.n, 0) AS n_kgrams, coalesce(f.n, 0) AS n_fingerprints FROM {source} p LEFT JOIN (SELECT submission_id, count(*) AS n FROM tok GROUP BY 1) t USING (submission_id)
LEFT JOIN (SELECT submission_id, count(*) AS n FROM grams GROUP BY 1) g USING (submission_id) LEFT JOIN (SELECT submission_id, count(*) AS n FROM fps GROUP BY 1) f USING (submission_id)"""


@query(f"{PROSE} SELECT {_COUNTS.format(source='prose')}")
def fingerprint_counts(spark, sf):
    texts = src.prose(spark, sf)
    return fp.prose_counts(texts)


@query(f"{CODE}, c AS (SELECT {_COUNTS.format(source='programs')}) SELECT submission_id, CASE WHEN n_tokens = 0 THEN 'failed' ELSE 'fingerprinted' END AS status, CASE WHEN n_tokens = 0 THEN 'no tokens' END AS error, n_fingerprints FROM c")
def fingerprint_status(spark, sf):
    code = _programs(spark, sf)
    counts = fp.fingerprint_counts(code, tk.tokenize_any(code))
    none = F.col("n_tokens") == 0
    return counts.select("submission_id", F.when(none, "failed").otherwise("fingerprinted").alias("status"), F.when(none, "no tokens").alias("error"), "n_fingerprints")


@query(f"{PROSE}, c AS (SELECT {_COUNTS.format(source='prose')}) SELECT assignment_id, sum(n_kgrams)::BIGINT AS n_kgrams, sum(n_fingerprints)::BIGINT AS n_fingerprints, round(sum(n_fingerprints)::DOUBLE / nullif(sum(n_kgrams), 0), 6) AS density FROM c GROUP BY 1")
def winnow_density(spark, sf):
    texts = src.prose(spark, sf)
    counts = fp.prose_counts(texts).groupBy("assignment_id").agg(F.sum("n_kgrams").alias("n_kgrams"), F.sum("n_fingerprints").alias("n_fingerprints"))
    return counts.withColumn("density", F.round(F.try_divide("n_fingerprints", "n_kgrams"), 6))


@query(f"""WITH RECURSIVE {S.PROGRAMS}, duo AS (SELECT * REPLACE ((submission_id // 36)::VARCHAR || '/' || (submission_id % 18)::VARCHAR AS assignment_id) FROM programs), {S.tokens('duo')}, {S.prints(3, 2)}, {S.SHARED}
SELECT c.assignment_id, a, b, shared AS intersection, x.size + y.size - shared AS "union", x.size AS size_a, y.size AS size_b, shared::DOUBLE / (x.size + y.size - shared) AS score FROM cand c JOIN sizes x ON x.submission_id = a JOIN sizes y ON y.submission_id = b""")
def demo_pipeline(spark, sf):
    """The pipeline on couples of texts with k = 3 and w = 2: each program of one template with the next of it."""
    couple = F.concat(F.floor(F.col("submission_id") / 36).cast("string"), F.lit("/"), (F.col("submission_id") % 18).cast("string"))
    duo = _programs(spark, sf).withColumn("assignment_id", couple)
    return pr.jaccard(pr.pair_counts(fp.code_arrays(duo, 3, 2)))


# Pairs and sets


@query(f"{CODE} SELECT assignment_id, hash, submission_id // 1000 AS block, list_sort(list(submission_id)) AS submission_ids, count(*) AS n FROM sets GROUP BY 1, 2, 3")
def inverted_index(spark, sf):
    return pr.inverted_index(fp.code_sets(_programs(spark, sf)))


@query(f"{CODE} SELECT * FROM cand")
def candidate_pairs(spark, sf):
    return pr.candidate_pairs(_code_arrays(spark, sf))


@query("SELECT source AS assignment_id, count(*) AS n, (count(*) * (count(*) - 1)) // 2 AS pairs FROM documents GROUP BY 1")
def all_pairs(spark, sf):
    return pr.all_pairs(src.prose(spark, sf))


_STATS = "SELECT p.assignment_id, n, naive AS {naive}, coalesce(c, 0) AS {candidates}, {more} CASE WHEN naive = 0 THEN 0.0::DOUBLE ELSE round((1 - coalesce(c, 0)::DOUBLE / naive) * 100, 1) END AS reduction FROM (SELECT assignment_id, count(*) AS n, (count(*) * (count(*) - 1)) // 2 AS naive FROM {source} GROUP BY 1) p LEFT JOIN (SELECT assignment_id, count(*) AS c FROM cand GROUP BY 1) USING (assignment_id)"


@query(f"{CODE} {_STATS.format(naive='naive_pairs', candidates='candidates', more='', source='programs')}")
def candidate_stats(spark, sf):
    sets = kept(_code_arrays(spark, sf))
    return pr.candidate_stats(_programs(spark, sf), pr.class_pairs(sets, kept(pr.class_members(sets))))


_SIZED = "FROM cand c JOIN sizes x ON x.submission_id = a JOIN sizes y ON y.submission_id = b"


@query(f'{CODE} SELECT c.assignment_id, a, b, shared AS intersection, x.size + y.size - shared AS "union", x.size AS size_a, y.size AS size_b, shared::DOUBLE / (x.size + y.size - shared) AS score {_SIZED}')
def jaccard_pairs(spark, sf):
    return pr.jaccard(pr.pair_counts(_code_arrays(spark, sf)))


@query(f"{PROSE} SELECT c.assignment_id, a, b, shared::DOUBLE / x.size AS a_in_b, shared::DOUBLE / y.size AS b_in_a {_SIZED}")
def containment_pairs(spark, sf):
    return pr.containment(pr.pair_counts(_prose_arrays(spark, sf)))


@query(f"{PROSE} SELECT x.submission_id AS a, y.submission_id AS b, count(*) AS shared FROM sets x JOIN sets y USING (hash) WHERE x.submission_id < y.submission_id GROUP BY 1, 2")
def corpus_pairs(spark, sf):
    return pr.candidate_pairs(_prose_arrays(spark, sf), None)


# Of each assignment's programs, those with an even number against those with an odd one.
_EVEN, _ODD = "submission_id % 2 = 0", "submission_id % 2 = 1"


def _sides(spark, sf):
    """The different hashes of either side, which is all that operations on sets of hashes look at."""
    found = kept(fp.code_sets(_programs(spark, sf)).select((F.col("submission_id") % 2).alias("side"), "hash").distinct())
    return found.where("side = 0").select("hash"), found.where("side = 1").select("hash")


@query(f"{CODE} SELECT DISTINCT hash FROM sets WHERE {_EVEN} INTERSECT SELECT hash FROM sets WHERE {_ODD}")
def set_intersect(spark, sf):
    return pr.intersect_hashes(*_sides(spark, sf))


@query(f"{CODE} SELECT hash FROM sets WHERE {_EVEN} UNION SELECT hash FROM sets WHERE {_ODD}")
def set_union(spark, sf):
    return pr.union_hashes(*_sides(spark, sf))


@query(f"{CODE} SELECT hash FROM sets WHERE {_EVEN} EXCEPT SELECT hash FROM sets WHERE {_ODD}")
def set_except(spark, sf):
    return pr.except_hashes(*_sides(spark, sf))


# Boilerplate


@query(f"{LATEST} SELECT assignment_id, hash, occurrences, total, frequency FROM stats")
def hash_frequency(spark, sf):
    latest = _latest(spark, sf)
    return bp.hash_frequency(_sets_of(latest), latest)


@query(f"{LATEST} SELECT * FROM stats")
def boilerplate_stats(spark, sf):
    latest = _latest(spark, sf)
    return _stats_of(_sets_of(latest), latest)


def _starter(spark, sf):
    items = src.read_table(spark, sf, "benchmark").select(F.lit("starter").alias("assignment_id"), F.col("item_id").alias("submission_id"), "text")
    return fp.prose_sets(items).select("hash").distinct()


_STARTER_SQL = f"""WITH RECURSIVE starter AS MATERIALIZED (WITH tok AS (SELECT 'starter' AS assignment_id, item_id AS submission_id, unnest(l) AS type, unnest(range(len(l))) AS pos, 1 AS line FROM (SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+|[0-9]+') AS l FROM benchmark)),
{S.prints()} SELECT DISTINCT hash FROM fps), {S.PROSE}, {S.prints()}, {S.SHARED}, {S.stats('prose', 0.2, 'SELECT hash FROM starter')}"""


def _prose_stats(spark, sf):
    return bp.boilerplate_stats(bp.hash_frequency(_prose_sets(spark, sf), src.prose(spark, sf)), _starter(spark, sf), 0.2)


@query(f"{_STARTER_SQL} SELECT assignment_id, hash, occurrences FROM stats WHERE is_boilerplate")
def boilerplate_hashes(spark, sf):
    return _prose_stats(spark, sf).where("is_boilerplate").select("assignment_id", "hash", "occurrences")


@query(f"{_STARTER_SQL} SELECT assignment_id, count(*) AS n_hashes, count(*) FILTER (is_boilerplate) AS n_boilerplate FROM stats GROUP BY 1")
def boilerplate_summary(spark, sf):
    return bp.summary(_prose_stats(spark, sf))


@query(f"{LATEST} SELECT assignment_id, submission_id, hash FROM flagged WHERE NOT is_boilerplate")
def boilerplate_anti(spark, sf):
    latest = _latest(spark, sf)
    sets = _sets_of(latest)
    return bp.without_boilerplate(sets, _stats_of(sets, latest)).select("assignment_id", "submission_id", "hash")


@query(f"{LATEST} SELECT * FROM adj")
def adjusted_pairs(spark, sf):
    return _results(spark, sf)


# Evidence


@query(f"{LATEST} SELECT * FROM raws")
def raw_regions(spark, sf):
    return ev.raw_regions(_latest_prints(spark, sf))


@query(f"{LATEST} SELECT assignment_id, a, b, unnest(regions, recursive := true) FROM folded")
def matched_regions(spark, sf):
    regions = ev.matched_regions(ev.raw_regions(_latest_prints(spark, sf)))
    return regions.select("assignment_id", "a", "b", F.inline("regions"))


@query(f"{LATEST} SELECT assignment_id, a, b, lines_a, lines_b FROM folded")
def line_coverage(spark, sf):
    regions = ev.matched_regions(ev.raw_regions(_latest_prints(spark, sf)))
    return regions.select("assignment_id", "a", "b", ev.line_coverage(F.col("regions"), "a").alias("lines_a"), ev.line_coverage(F.col("regions"), "b").alias("lines_b"))


@query(f"WITH {S.PROGRAMS}, {S.tokens()} SELECT assignment_id, submission_id, count(*) FILTER (type IN ('FOR', 'WHILE')) AS loops, count(*) FILTER (type IN ('IF', 'ELSE', 'ELIF')) AS conditions, count(*) FILTER (type IN ('DEF', 'FUNCTION')) AS functions FROM tok GROUP BY 1, 2")
def structure_counts(spark, sf):
    return ev.structure_counts(_code_tokens(spark, sf))


_FACTS = """
counts AS (SELECT submission_id, count(*) FILTER (type IN ('FOR', 'WHILE')) AS loops, count(*) FILTER (type IN ('IF', 'ELSE', 'ELIF')) AS conditions, count(*) FILTER (type IN ('DEF', 'FUNCTION')) AS functions FROM tok GROUP BY 1),
starts AS (SELECT submission_id, coalesce(list(type ORDER BY pos) FILTER (pos < 20), []) AS types, coalesce(list(original ORDER BY pos) FILTER (type = 'VAR'), [])[1:10] AS names FROM tok GROUP BY 1),
flags AS (SELECT adj.*, n_regions, lines_a, lines_b, coalesce(c1.loops > 0 AND c1.loops = c2.loops, false) AS same_loops, coalesce(c1.conditions > 0 AND c1.conditions = c2.conditions, false) AS same_conditions, coalesce(c1.functions > 0 AND c1.functions = c2.functions, false) AS same_functions,
  coalesce(n >= 5 AND s1.types[1:n] = s2.types[1:n] AND m > 0 AND len(list_filter(list_zip(s1.names[1:m], s2.names[1:m]), lambda x: x[1] <> x[2]))::DOUBLE / nullif(m, 0) > 0.3, false) AS renamed
  FROM adj JOIN folded USING (assignment_id, a, b) LEFT JOIN counts c1 ON c1.submission_id = a LEFT JOIN counts c2 ON c2.submission_id = b LEFT JOIN starts s1 ON s1.submission_id = a LEFT JOIN starts s2 ON s2.submission_id = b,
  LATERAL (SELECT least(len(s1.types), len(s2.types)) AS n, least(len(s1.names), len(s2.names)) AS m)),
analysed AS (SELECT *, CASE WHEN raw >= 0.7::DOUBLE THEN 'high' WHEN raw >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk, array_to_string(list_filter([
  CASE WHEN adjusted >= 0.7::DOUBLE THEN 'very_high' WHEN adjusted >= 0.4::DOUBLE THEN 'moderate' WHEN adjusted >= 0.2::DOUBLE THEN 'low_moderate' END, CASE WHEN overlap > 0 THEN 'boilerplate' END, CASE WHEN n_regions > 0 THEN 'regions' END,
  CASE WHEN lines_a > 5 OR lines_b > 5 THEN 'lines' END, CASE WHEN renamed THEN 'renamed' END, CASE WHEN same_loops THEN 'loops' END, CASE WHEN same_conditions THEN 'conditions' END, CASE WHEN same_functions THEN 'functions' END,
  CASE WHEN n_clean > 0 THEN 'clean_matches' END], lambda x: x IS NOT NULL), ',') AS found FROM flags)"""
ANALYSED = f"{LATEST}, {_FACTS}"


@query(f"{ANALYSED} SELECT assignment_id, a, b, renamed FROM flags")
def renaming_flag(spark, sf):
    latest = _latest(spark, sf)
    tokens = _tokens_of(latest)
    return ev.renaming_flag(_results_of(latest, pr.distinct_hashes(fp.fingerprints(tokens))).select("assignment_id", "a", "b"), ev.beginnings(tokens))


@query(f"{ANALYSED} SELECT assignment_id, a, b, same_loops, same_conditions, same_functions FROM flags")
def structure_flags(spark, sf):
    latest = _latest(spark, sf)
    tokens = _tokens_of(latest)
    return ev.structure_flags(_results_of(latest, pr.distinct_hashes(fp.fingerprints(tokens))).select("assignment_id", "a", "b"), ev.structure_counts(tokens))


@query(f"{ANALYSED} SELECT assignment_id, a, b, risk FROM analysed")
def risk_level(spark, sf):
    return _results(spark, sf).select("assignment_id", "a", "b", ev.risk_level(F.col("raw")).alias("risk"))


@query(f"{ANALYSED} SELECT assignment_id, a, b, CASE WHEN found = '' THEN 'none' ELSE found END AS evidence FROM analysed")
def evidence_codes(spark, sf):
    return ev.analyze(_programs(spark, sf)).select("assignment_id", "a", "b", "evidence")


@query(f"{ANALYSED} SELECT assignment_id, a, b, shared, raw, adjusted, overlap, n_clean, n_regions, lines_a, lines_b, renamed, risk, CASE WHEN found = '' THEN 'none' ELSE found END AS evidence FROM analysed")
def analyze_cohort(spark, sf):
    return ev.analyze(_programs(spark, sf)).select("assignment_id", "a", "b", "shared", "raw", "adjusted", "overlap", "n_clean", "n_regions", "lines_a", "lines_b", "renamed", "risk", "evidence")


_SENTENCES = """list_filter([CASE WHEN adjusted >= 0.7::DOUBLE THEN 'Nearly all of the remaining code agrees (' || printf('%.1f%%', round(adjusted * 100, 1)) || ').' WHEN adjusted >= 0.4::DOUBLE THEN 'A good part of the remaining code agrees (' || printf('%.1f%%', round(adjusted * 100, 1)) || ').'
    WHEN adjusted >= 0.2::DOUBLE THEN 'Some of the remaining code agrees (' || printf('%.1f%%', round(adjusted * 100, 1)) || ').' END,
  CASE WHEN overlap > 0 THEN 'Of ' || printf('%.1f%%', round(raw * 100, 1)) || ' agreement, ' || printf('%.1f%%', round(overlap * 100, 1)) || ' is boilerplate.' END,
  CASE WHEN n_regions > 0 THEN n_regions || ' region(s) match.' END, CASE WHEN n_regions > 0 AND (lines_a > 5 OR lines_b > 5) THEN 'They cover ' || lines_a || ' and ' || lines_b || ' lines.' END,
  CASE WHEN renamed THEN 'Names differ while the structure is the same.' END, CASE WHEN same_loops THEN 'The same number of loops.' END, CASE WHEN same_conditions THEN 'The same number of conditions.' END,
  CASE WHEN same_functions THEN 'The same number of functions.' END, CASE WHEN n_clean > 0 THEN n_clean || ' fingerprints beyond boilerplate match.' END, CASE WHEN found = '' THEN 'Nothing speaks for a copy.' END], lambda x: x IS NOT NULL)"""


@query(f"{ANALYSED} SELECT assignment_id, a, b, array_to_string({_SENTENCES}, ' ') AS explanation FROM analysed")
def explanations(spark, sf):
    return ev.explanation(ev.analyze(_programs(spark, sf))).select("assignment_id", "a", "b", F.array_join("explanation", " ").alias("explanation"))


@query(f"{LATEST} SELECT assignment_id, a, b, x.student_id AS student_a, y.student_id AS student_b, x.file_name AS file_a, y.file_name AS file_b, raw FROM adj JOIN latest x USING (assignment_id) JOIN latest y USING (assignment_id) WHERE x.submission_id = a AND y.submission_id = b")
def pair_details(spark, sf):
    names = _latest(spark, sf)
    side = lambda s: names.select("assignment_id", F.col("submission_id").alias(s), F.col("student_id").alias(f"student_{s}"), F.col("file_name").alias(f"file_{s}"))
    return _results_of(names).join(side("a"), ["assignment_id", "a"]).join(side("b"), ["assignment_id", "b"]).select("assignment_id", "a", "b", "student_a", "student_b", "file_a", "file_b", "raw")


@query(f"{LATEST} SELECT assignment_id, a, b, raw, adjusted, coalesce(x.lang, 'python') AS language, length(x.code) AS chars_a, length(y.code) AS chars_b FROM adj JOIN resolved x USING (assignment_id) JOIN resolved y USING (assignment_id) WHERE x.submission_id = a AND y.submission_id = b")
def result_detail(spark, sf):
    latest = _latest(spark, sf)
    code = latest.withColumn("lang", lg.resolve_language(F.col("language"), F.col("code"), F.col("file_name")))
    side = lambda s: code.select("assignment_id", F.col("submission_id").alias(s), F.col("lang").alias(f"lang_{s}"), F.length("code").cast("long").alias(f"chars_{s}"))
    return _results_of(latest).join(side("a"), ["assignment_id", "a"]).join(side("b"), ["assignment_id", "b"]).select("assignment_id", "a", "b", "raw", "adjusted", F.coalesce("lang_a", F.lit("python")).alias("language"), "chars_a", "chars_b")


# Clusters


_CLUSTERS = """
edges AS (SELECT assignment_id, a, b, adjusted AS score FROM adj WHERE adjusted >= 0.5::DOUBLE),
reach(assignment_id, x, y) AS (SELECT assignment_id, x, x FROM (SELECT assignment_id, a AS x FROM edges UNION SELECT assignment_id, b FROM edges) UNION
  SELECT r.assignment_id, r.x, e.y FROM reach r JOIN (SELECT assignment_id, a AS x, b AS y FROM edges UNION SELECT assignment_id, b, a FROM edges) e ON e.assignment_id = r.assignment_id AND e.x = r.y),
members AS (SELECT assignment_id, x AS submission_id, min(y) AS cluster_id FROM reach GROUP BY 1, 2)"""


@query(f"{LATEST}, {_CLUSTERS} SELECT * FROM members")
def clusters(spark, sf):
    return cl.clusters(cl.cluster_edges(_results(spark, sf)))


@query(f"""{LATEST}, {_CLUSTERS}, s AS (SELECT assignment_id, cluster_id, round(avg(score), 9) AS average, max(score) AS highest, list({{'a': a, 'b': b}} ORDER BY score DESC, a, b)[1] AS best FROM edges JOIN members USING (assignment_id) WHERE submission_id = a GROUP BY 1, 2),
m AS (SELECT assignment_id, cluster_id, count(*) AS size, list_sort(list(submission_id)) AS members, list_sort(list_distinct(list(student_id))) AS students, CASE WHEN count(submitted_at) >= 2 THEN round((epoch_us(max(submitted_at)) - epoch_us(min(submitted_at))) / 60000000)::BIGINT END AS within_minutes FROM members JOIN latest USING (assignment_id, submission_id) GROUP BY 1, 2)
SELECT assignment_id, cluster_id, size, average, highest, best.a AS best_a, best.b AS best_b, members, students, within_minutes FROM m JOIN s USING (assignment_id, cluster_id)""")
def cluster_stats(spark, sf):
    latest = _latest(spark, sf)
    edges = cl.cluster_edges(_results_of(latest))
    return cl.cluster_stats(cl.clusters(edges), edges, latest)


# Differences


def _code_pairs(spark, sf):
    """All scored pairs with their code."""
    code = _latest(spark, sf)
    named = code.withColumn("lang", lg.resolve_language(F.col("language"), F.col("code"), F.col("file_name")))
    side = lambda s: named.select("assignment_id", F.col("submission_id").alias(s), F.col("code").alias(f"code_{s}"), F.col("lang").alias(f"lang_{s}"))
    pairs = _results_of(code).select("assignment_id", "a", "b")
    return pairs.join(side("a"), ["assignment_id", "a"]).join(side("b"), ["assignment_id", "b"]).withColumn("language", F.col("lang_a"))


@query(f"{LATEST}, {S.DIFF} SELECT * FROM ops")
def pair_diff(spark, sf):
    return df_.pair_diff(_code_pairs(spark, sf)).drop("token_equal", "token_delete", "token_insert", "truncated")


@query()
def pair_token_diff(spark, sf):
    return df_.pair_diff(_code_pairs(spark, sf)).where("type = 'modify'").select("assignment_id", "a", "b", "op_no", "token_equal", "token_delete", "token_insert", "truncated")


@query(f"""{LATEST}, {S.DIFF} SELECT assignment_id, a, b, count(*) FILTER (type = 'equal') AS regions, coalesce(sum(a_end - a_start + 1) FILTER (type = 'equal'), 0)::BIGINT AS equal_lines, coalesce(sum(b_end - b_start + 1) FILTER (type = 'insert'), 0)::BIGINT AS insertions,
  coalesce(sum(a_end - a_start + 1) FILTER (type = 'delete'), 0)::BIGINT AS deletions, coalesce(sum(greatest(a_end - a_start, b_end - b_start) + 1) FILTER (type = 'modify'), 0)::BIGINT AS modifications FROM ops GROUP BY 1, 2, 3""")
def diff_stats(spark, sf):
    return df_.diff_stats(df_.pair_diff(_code_pairs(spark, sf)))


@query(f"""{LATEST}, li AS (SELECT assignment_id, submission_id, trim(unnest(string_split(code, chr(10))), ' ') AS line FROM latest), n AS (SELECT assignment_id, submission_id, line, count(*) AS n FROM li GROUP BY ALL), t AS (SELECT submission_id, sum(n)::BIGINT AS n FROM n GROUP BY 1),
c AS (SELECT adj.assignment_id, a, b, sum(least(x.n, y.n))::BIGINT AS common FROM adj JOIN n x ON x.assignment_id = adj.assignment_id AND x.submission_id = a JOIN n y ON y.assignment_id = adj.assignment_id AND y.submission_id = b AND y.line = x.line GROUP BY ALL)
SELECT adj.assignment_id, a, b, coalesce(common, 0) AS common, p.n - coalesce(common, 0) AS only_a, q.n - coalesce(common, 0) AS only_b FROM adj LEFT JOIN c USING (assignment_id, a, b) JOIN t p ON p.submission_id = a JOIN t q ON q.submission_id = b""")
def line_overlap(spark, sf):
    latest = _latest(spark, sf)
    return df_.line_overlap(_results_of(latest), latest)


# Scores from elsewhere


@query(f"""{LATEST} SELECT a.assignment_id, a, b, adjusted, md5(CASE WHEN length(p.code || repeat('x', ((a * 13) % 4000)::INT)) > 3000 THEN (p.code || repeat('x', ((a * 13) % 4000)::INT))[1:3000] || chr(10) || '[cut]' ELSE p.code || repeat('x', ((a * 13) % 4000)::INT) END) AS prompt
FROM adj a JOIN latest p ON p.submission_id = a WHERE adjusted >= 0.7::DOUBLE * ((a % 10)::DOUBLE / 10)""")
def semantic_candidates(spark, sf):
    latest = _latest(spark, sf)
    chosen = it.semantic_candidates(_results_of(latest), (F.col("a") % 10) / 10)
    code = latest.select(F.col("submission_id").alias("a"), F.concat("code", F.repeat(F.lit("x"), ((F.col("submission_id") * 13) % 4000).cast("int"))).alias("code"))
    return chosen.join(code, "a").select("assignment_id", "a", "b", "adjusted", F.md5(it.prompt_text(F.col("code"))).alias("prompt"))


@query(f"{PROSE} SELECT c.assignment_id, a, b, shared, CASE WHEN l.quality - 1 + l.toxic * 2 >= 0 THEN least((l.quality - 1 + l.toxic * 2)::DOUBLE, 1.0::DOUBLE) END AS semantic FROM cand c LEFT JOIN labels l ON l.doc_id = a")
def semantic_merge(spark, sf):
    scores = src.read_table(spark, sf, "labels").select(F.col("doc_id").alias("a"), (F.col("quality") - 1 + F.col("toxic") * 2).cast("double").alias("semantic_score"))
    return it.semantic_merge(pr.candidate_pairs(_prose_arrays(spark, sf)), scores, ["a"]).select("assignment_id", "a", "b", "shared", "semantic")


# Versions


_ATTEMPTS = "a AS (SELECT event_type AS assignment_id, event_id AS submission_id, 'S' || user_id AS student_id, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'queued' ELSE 'fingerprinted' END AS status, ts AS submitted_at FROM events), v AS (SELECT *, row_number() OVER (PARTITION BY assignment_id, student_id ORDER BY submitted_at, submission_id) AS version FROM a)"


@query(f"WITH {_ATTEMPTS} SELECT submission_id, assignment_id, student_id, version FROM v")
def assign_version(spark, sf):
    return vs.assign_version(src.attempts(spark, sf)).select("submission_id", "assignment_id", "student_id", "version")


@query(f"WITH {_ATTEMPTS} SELECT assignment_id, student_id, submission_id, version FROM (SELECT *, row_number() OVER (PARTITION BY assignment_id, student_id ORDER BY version DESC, submitted_at DESC, submission_id DESC) AS nth FROM v WHERE status = 'fingerprinted') WHERE nth = 1")
def latest_version(spark, sf):
    return vs.latest_version(vs.assign_version(src.attempts(spark, sf))).select("assignment_id", "student_id", "submission_id", "version")


@query(f"WITH {_ATTEMPTS} SELECT submission_id, version, row_number() OVER w AS newest, row_number() OVER w = 1 AS is_latest FROM v WINDOW w AS (PARTITION BY assignment_id, student_id ORDER BY version DESC)")
def version_history(spark, sf):
    return vs.version_history(vs.assign_version(src.attempts(spark, sf))).select("submission_id", "version", "newest", "is_latest")


@query("SELECT * FROM (SELECT o_custkey AS key, o_orderdate AS changed_at, lag(d) OVER w AS old_deadline, d AS new_deadline FROM (SELECT o_custkey, o_orderdate, date_trunc('month', o_orderdate) AS d FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, d)) WHERE old_deadline <> new_deadline")
def deadline_history(spark, sf):
    changes = src.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("changed_at"), F.date_trunc("month", "o_orderdate").alias("deadline"))
    return vs.deadline_history(changes)


@query("SELECT DISTINCT event_type AS assignment_id, 'S' || user_id AS student_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.user_id = e.user_id AND x.value > 60)")
def enroll_new(spark, sf):
    log = src.attempts(spark, sf)
    return vs.enroll_new(log.where("value > 60"), log)


@query("SELECT assignment_id, submission_id, student_id, place FROM (SELECT event_type AS assignment_id, event_id AS submission_id, 'S' || user_id AS student_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 100")
def recent_submissions(spark, sf):
    """A report of the last hundred submissions of each assignment."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("assignment_id").orderBy(F.desc("submitted_at"), "submission_id"))
    return src.attempts(spark, sf).select("assignment_id", "submission_id", "student_id", place.alias("place")).where("place <= 100")


# Reports


@query(f"{LATEST} SELECT assignment_id, a, b, raw, adjusted, row_number() OVER (PARTITION BY assignment_id ORDER BY raw DESC, adjusted DESC, a, b) AS place FROM adj")
def ranked_results(spark, sf):
    return rp.ranked(_results(spark, sf)).select("assignment_id", "a", "b", "raw", "adjusted", "place")


@query(f"{LATEST} SELECT assignment_id, a, b, rank() OVER (PARTITION BY assignment_id ORDER BY round(raw * 1000) DESC) AS rank FROM adj")
def competition_rank(spark, sf):
    return rp.competition_rank(_results(spark, sf)).select("assignment_id", "a", "b", "rank")


@query(f"{LATEST} SELECT * FROM (SELECT assignment_id, a, b, raw, row_number() OVER (PARTITION BY assignment_id ORDER BY raw DESC, adjusted DESC, a, b) AS place FROM adj) WHERE place <= 5")
def top_pairs(spark, sf):
    return rp.top_pairs(_results(spark, sf)).select("assignment_id", "a", "b", "raw", "place")


@query(f"{LATEST} SELECT assignment_id, a, b, CASE WHEN raw >= 0.7::DOUBLE THEN 'high' WHEN raw >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk FROM adj WHERE raw < 0.4::DOUBLE")
def results_by_risk(spark, sf):
    return rp.by_risk(_results(spark, sf), "low").select("assignment_id", "a", "b", "risk")


@query(f"{LATEST} SELECT assignment_id, count(*) AS pairs, round(avg(raw), 9) AS average, count(*) FILTER (raw >= 0.7::DOUBLE) AS high, count(*) FILTER (raw >= 0.4::DOUBLE AND raw < 0.7::DOUBLE) AS medium FROM adj GROUP BY 1")
def result_analytics(spark, sf):
    return rp.result_analytics(_results(spark, sf))


_BUCKET = "CASE WHEN raw >= 0.8::DOUBLE THEN '80-100' WHEN raw >= 0.6::DOUBLE THEN '60-80' WHEN raw >= 0.4::DOUBLE THEN '40-60' WHEN raw >= 0.2::DOUBLE THEN '20-40' ELSE '0-20' END"


@query(f"{LATEST} SELECT assignment_id, bucket, count(a) AS n FROM (SELECT DISTINCT assignment_id, unnest(['0-20', '20-40', '40-60', '60-80', '80-100']) AS bucket FROM adj) LEFT JOIN (SELECT assignment_id, a, {_BUCKET} AS bucket FROM adj) USING (assignment_id, bucket) GROUP BY 1, 2")
def score_histogram(spark, sf):
    return rp.score_histogram(_results(spark, sf))


@query("SELECT event_type AS assignment_id, count(DISTINCT user_id) AS students, count(*) AS submissions FROM events GROUP BY 1")
def distinct_students(spark, sf):
    return rp.distinct_students(src.attempts(spark, sf))


@query(f"{LATEST} SELECT p.assignment_id, count(*) AS total, count(*) FILTER (status = 'fingerprinted') AS fingerprinted, count(*) FILTER (status = 'failed') AS failed, coalesce(any_value(n), 0) AS results FROM programs p LEFT JOIN (SELECT assignment_id, count(*) AS n FROM adj GROUP BY 1) USING (assignment_id) GROUP BY 1")
def analysis_status(spark, sf):
    return rp.analysis_status(_programs(spark, sf), _results(spark, sf))


_OWNED = """o AS (SELECT o_orderkey AS assignment_id, o_custkey AS owner_id, o_orderdate AS created_at, coalesce(s.n, 0) AS students, coalesce(r.n, 0) AS results,
  CASE WHEN coalesce(r.n, 0) > 0 THEN 'completed' WHEN o_orderstatus IN ('F', 'O') THEN CASE WHEN coalesce(s.n, 0) >= 2 THEN 'ready' ELSE 'not_analyzed' END ELSE 'queued' END AS display_status FROM orders
  LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_orderkey = o_orderkey)"""


def _dashboard(spark, sf):
    found = src.read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("assignment_id"))
    return rp.owner_dashboard(src.assignments(spark, sf), src.handins(spark, sf), found)


@query(f"WITH {_OWNED} SELECT * FROM o")
def owner_dashboard(spark, sf):
    return _dashboard(spark, sf)


@query(f"WITH {_OWNED} SELECT owner_id, assignment_id, display_status, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, assignment_id) AS place FROM o")
def own_assignments(spark, sf):
    """What each owner sees: only assignments of their own, the newest first."""
    from pyspark.sql.window import Window

    owners = src.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("asking"))
    own = _dashboard(spark, sf).join(owners, F.col("owner_id") == F.col("asking"))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "assignment_id"))
    return own.select("owner_id", "assignment_id", "display_status", place.alias("place"))


@query(f"WITH {_OWNED} SELECT owner_id, count(*) AS assignments, sum(students)::BIGINT AS students, count(*) FILTER (display_status = 'completed') AS completed, count(*) FILTER (display_status = 'queued') AS running FROM o GROUP BY 1")
def owner_summary(spark, sf):
    return rp.owner_summary(_dashboard(spark, sf))


_STUDENTS = f"""e AS (SELECT DISTINCT l_suppkey AS student_id, l_orderkey AS assignment_id FROM lineitem),
last AS (SELECT assignment_id, student_id, max_by({{'s': submission_id, 'v': version}}, version) AS last FROM (SELECT l_orderkey AS assignment_id, l_suppkey AS student_id, l_orderkey * 10 + l_linenumber AS submission_id, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate, l_linenumber) AS version FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1, 2),
board AS (SELECT student_id, e.assignment_id, {_DEADLINE} AS deadline, {NOW} >= {_DEADLINE} AS is_closed, last.s AS submission_id, last.v AS version, CASE WHEN last IS NULL THEN 'pending' ELSE 'submitted' END AS state,
  last IS NULL AND {NOW} < {_DEADLINE} AND {_DEADLINE} <= {NOW} + INTERVAL 48 HOUR AS due_soon FROM e JOIN orders ON o_orderkey = e.assignment_id LEFT JOIN last USING (assignment_id, student_id))"""


def _board(spark, sf):
    hand = src.handins(spark, sf)
    sent = vs.assign_version(hand.where("line_status = 'F'"))
    return rp.student_dashboard(hand.select("student_id", "assignment_id").distinct(), src.assignments(spark, sf), sent, F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))


@query(f"WITH {_STUDENTS} SELECT * FROM board")
def student_dashboard(spark, sf):
    return _board(spark, sf)


@query(f"WITH {_STUDENTS} SELECT student_id, count(*) AS total, count(*) FILTER (state = 'submitted') AS submitted, count(*) FILTER (state = 'pending' AND NOT is_closed) AS pending, count(*) FILTER (due_soon) AS due_soon FROM board GROUP BY 1")
def student_stats(spark, sf):
    return rp.student_stats(_board(spark, sf))


@query(f"{LATEST} SELECT x.assignment_id, n AS found, naive AS possible_pairs, coalesce(c, 0) AS candidate_pairs, coalesce(c, 0) AS results_saved, reduction FROM ({_STATS.format(naive='naive', candidates='c', more='', source='latest')}) x")
def run_stats(spark, sf):
    latest = _latest(spark, sf)
    sets = _sets_of(latest)
    results = _results_of(latest, sets)
    return rp.run_stats(latest, results.select("assignment_id", "a", "b", "shared"), results)


# Sinks and streams


@query(f"{LATEST} SELECT assignment_id, a, b, raw, adjusted FROM adj")
def result_sink(spark, sf):
    path = st.work_folder(spark, "results")
    rows = _results(spark, sf).select("assignment_id", "a", "b", "raw", "adjusted")
    ig.replace_results(rows, path)
    return spark.read.schema("a long, b long, raw double, adjusted double, assignment_id string").parquet(path).select("assignment_id", "a", "b", "raw", "adjusted")


@query(f"{LATEST} SELECT assignment_id, hash, occurrences, total, is_boilerplate FROM stats")
def boilerplate_sink(spark, sf):
    """All assignments are written twice; each holds its last statistics alone."""
    path = st.work_folder(spark, "boilerplate")
    latest = _latest(spark, sf)
    stats = _stats_of(_sets_of(latest), latest).select("assignment_id", "hash", "occurrences", "total", "is_boilerplate")
    ig.replace_boilerplate(stats.withColumn("occurrences", F.lit(0).cast("long")), path)
    ig.replace_boilerplate(stats, path)
    return spark.read.schema("hash long, occurrences long, total long, is_boilerplate boolean, assignment_id string").parquet(path).select(*stats.columns)


@query(f"{CODE} SELECT assignment_id, submission_id, hash FROM sets")
def index_sink(spark, sf):
    path = st.work_folder(spark, "index")
    sets = _code_sets(spark, sf)
    ig.add_to_index(sets.where("submission_id % 2 = 0"), path)
    ig.add_to_index(sets, path)
    return spark.read.parquet(path)

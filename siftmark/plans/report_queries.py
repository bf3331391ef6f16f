"""Queries over stored layouts, sketches, scorers, long texts and archives, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boilerplate as bp
from ..operators import clusters as cl
from ..operators import evidence as ev
from ..operators import fingerprint as fp
from ..operators import intake as it
from ..operators import long_diff as ld
from ..operators import pairs as pr
from ..operators import reports as rp
from ..sources import archives as ar
from ..sources import ingest as ig
from ..sources import layout as lo
from ..sources import programs as src
from ..sources.durable import kept, new_folder
from . import sql as S
from .catalog import _CLUSTERS, _FACTS, _INGESTED, _SENTENCES, CODE, LATEST, PROSE, _code_arrays, _files, _latest, _latest_prints, _programs, _prose_arrays, _results_of, _sets_of, _stats_of
from .registry import query

# Layout


@query(f"WITH {S.PROGRAMS} SELECT submission_id, assignment_id, student_id, version, md5(code) AS code FROM programs WHERE assignment_id IN (SELECT assignment_id FROM programs WHERE student_id = 'S50')")
def scan_wanted(spark, sf):
    """All submissions of the cohorts that one student has handed in to; of the stored folders only theirs are read."""
    path = new_folder(spark, "submissions")
    programs = _programs(spark, sf)
    lo.store_submissions(programs, path)
    wanted = programs.where("student_id = 'S50'").select("assignment_id").distinct()
    return lo.scan_wanted(spark, path, F.broadcast(wanted)).select("submission_id", "assignment_id", "student_id", "version", F.md5("code").alias("code"))


@query(f"WITH {S.PROGRAMS}, files AS (SELECT assignment_id || '#' || (submission_id // 100) || '!' || assignment_id || '/' || file_name AS path, code FROM programs) {_INGESTED}")
def ingest_zip_ranges(spark, sf):
    """As ingest_zip, of archives in files: each is read by ranges of its entries."""
    folder = new_folder(spark, "archives")
    stored = kept(ar.write_archives(ig.zip_files(_files(spark, sf)), folder.removeprefix("file:")))
    return ig.ingest_files(ar.read_stored(stored).where("error IS NULL").select("path", "content"))


# Counts


@query("""SELECT event_type AS assignment_id, span, count(DISTINCT user_id) AS students, count(*) AS submissions, true AS close
FROM events, (VALUES ('all', DATE '1900-01-01', DATE '2999-01-01'), ('week', DATE '2024-01-08', DATE '2024-01-14')) AS s(span, d0, d1) WHERE ts::DATE BETWEEN d0 AND d1 GROUP BY 1, 2""")
def students_in_span(spark, sf):
    """Sketches by day, merged for two spans, beside exact counts: close says whether the estimate is within two percent."""
    attempts = src.attempts(spark, sf)
    sketches = kept(rp.student_sketches(attempts))
    spans = {"all": (None, None), "week": (F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"))}
    out = None
    for span, (first, last) in spans.items():
        day = F.to_date("submitted_at")
        exact = attempts if first is None else attempts.where((day >= first) & (day <= last))
        exact = exact.groupBy("assignment_id").agg(F.count_distinct("student_id").alias("exact"))
        got = rp.students_in_span(sketches, first, last).join(exact, "assignment_id")
        got = got.select("assignment_id", F.lit(span).alias("span"), F.col("exact").alias("students"), "submissions", (F.abs(F.col("students") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1) WHEN event_id % 10 = 1 THEN '{"outer": ' || props || ', "list": [1, "x"]}' ELSE props END AS props FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(props) THEN props END AS j FROM t)
SELECT event_id, j IS NULL AS broken, try_cast(json_extract_string(j, '$.k') AS INT) AS k, try_cast(json_extract_string(j, '$.outer.k') AS INT) AS inner_k, json_extract_string(j, '$.list[1]') AS second FROM j""")
def event_details(spark, sf):
    """Typed values of the events' JSON, of which one in ten is broken and one in ten is nested."""
    nested = F.concat(F.lit('{"outer": '), "props", F.lit(', "list": [1, "x"]}'))
    text = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 10 == 1, nested).otherwise(F.col("props"))
    found = it.event_details(text, {"k": ("$.k", "int"), "inner_k": ("$.outer.k", "int"), "second": ("$.list[1]", "string")})
    return src.read_table(spark, sf, "events").select("event_id", F.try_parse_json(text).isNull().alias("broken"), *(c.alias(n) for n, c in found.items()))


# Evidence


@query(f"{LATEST}, held AS (SELECT assignment_id, hash FROM sets GROUP BY 1, 2 HAVING count(*) > 1), l AS (SELECT DISTINCT assignment_id, submission_id, unnest(range(start_line, end_line + 1)) AS line FROM fps JOIN held USING (assignment_id, hash)) SELECT assignment_id, submission_id, count(*) AS lines FROM l GROUP BY 1, 2")
def covered_lines(spark, sf):
    """Lines of each submission that are in a fingerprint which another one of its cohort has too."""
    prints = _latest_prints(spark, sf)
    held = prints.select("assignment_id", "submission_id", "hash").distinct().groupBy("assignment_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("assignment_id", "hash")
    matched = prints.join(held, ["assignment_id", "hash"], "left_semi").select("assignment_id", "submission_id", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return ev.covered_lines(matched, ["assignment_id", "submission_id"])


_STARTED = LATEST.replace(S.stats("latest"), S.stats("latest", starter="SELECT hash FROM sets WHERE submission_id IN (SELECT min(submission_id) FROM latest GROUP BY assignment_id)"))


@query(f"{_STARTED}, {_FACTS} SELECT assignment_id, a, b, shared, raw, adjusted, overlap, n_clean, n_regions, lines_a, lines_b, renamed, risk, CASE WHEN found = '' THEN 'none' ELSE found END AS evidence FROM analysed")
def analyze_with_starter(spark, sf):
    """The analysis with starter code: that of each cohort's first latest submission."""
    latest = _latest(spark, sf)
    first = latest.groupBy("assignment_id").agg(F.min("submission_id").alias("submission_id"))
    starter = kept(fp.code_sets(latest.join(first, ["assignment_id", "submission_id"], "left_semi")))
    return ev.analyze(_programs(spark, sf), starter).select("assignment_id", "a", "b", "shared", "raw", "adjusted", "overlap", "n_clean", "n_regions", "lines_a", "lines_b", "renamed", "risk", "evidence")


_DUO = f"""WITH RECURSIVE {S.PROGRAMS}, duo AS (SELECT * REPLACE ((submission_id // 36)::VARCHAR || '/' || (submission_id % 18)::VARCHAR AS assignment_id) FROM programs), {S.tokens('duo')}, {S.prints(3, 2)}, {S.SHARED}, {S.stats('duo')}, {S.ADJUSTED}, {S.REGIONS}, {_FACTS},
n AS (SELECT submission_id, count(*) AS n FROM tok GROUP BY 1), f AS (SELECT submission_id, count(*) AS f FROM fps GROUP BY 1)"""


@query(f"""{_DUO} SELECT analysed.assignment_id, a, b, shared, raw, n1.n AS n_tokens_a, n2.n AS n_tokens_b, f1.f AS n_fingerprints_a, f2.f AS n_fingerprints_b, risk, array_to_string({_SENTENCES}, ' ') AS explanation,
  array_to_string(list_transform(regions, lambda r: r.sa || '-' || r.ea || ':' || r.sb || '-' || r.eb), ',') AS regions
FROM analysed JOIN (SELECT assignment_id, a, b, regions FROM folded) USING (assignment_id, a, b) JOIN n n1 ON n1.submission_id = a JOIN n n2 ON n2.submission_id = b JOIN f f1 ON f1.submission_id = a JOIN f f2 ON f2.submission_id = b""")
def text_report(spark, sf):
    """The whole report on couples of texts with k = 3 and w = 2: each program of one template with the next of it."""
    couple = F.concat(F.floor(F.col("submission_id") / 36).cast("string"), F.lit("/"), (F.col("submission_id") % 18).cast("string"))
    found = ev.text_report(_programs(spark, sf).withColumn("assignment_id", couple), 3, 2)
    places = F.array_join(F.transform("regions", lambda r: F.concat(r["sa"], F.lit("-"), r["ea"], F.lit(":"), r["sb"], F.lit("-"), r["eb"])), ",")
    return found.select("assignment_id", "a", "b", "shared", "raw", "n_tokens_a", "n_tokens_b", "n_fingerprints_a", "n_fingerprints_b", "risk", F.array_join("explanation", " ").alias("explanation"), places.alias("regions"))


@query(f"{LATEST} SELECT assignment_id, submission_id, hash FROM flagged WHERE is_boilerplate")
def boilerplate_semi(spark, sf):
    latest = _latest(spark, sf)
    sets = _sets_of(latest)
    return bp.only_boilerplate(sets, _stats_of(sets, latest)).select("assignment_id", "submission_id", "hash")


@query(f"{CODE} SELECT assignment_id, a, b, shared, row_number() OVER (PARTITION BY assignment_id ORDER BY shared DESC, a, b) AS place FROM cand")
def ranked_candidates(spark, sf):
    sets = kept(_code_arrays(spark, sf))
    members = kept(pr.class_members(sets))
    return pr.ranked_classes(kept(pr.class_pairs(sets, members)), members)


@query(f"""{LATEST}, {_CLUSTERS}, s AS (SELECT assignment_id, cluster_id, round(avg(score), 9) AS average FROM edges JOIN members USING (assignment_id) WHERE submission_id = a GROUP BY 1, 2), m AS (SELECT assignment_id, cluster_id, count(*) AS size FROM members GROUP BY 1, 2)
SELECT assignment_id, cluster_id, size, average, row_number() OVER (PARTITION BY assignment_id ORDER BY size DESC, average DESC, cluster_id) AS place FROM m JOIN s USING (assignment_id, cluster_id)""")
def ranked_clusters(spark, sf):
    latest = _latest(spark, sf)
    edges = cl.cluster_edges(_results_of(latest))
    return cl.ranked_clusters(cl.cluster_stats(cl.clusters(edges), edges, latest)).select("assignment_id", "cluster_id", "size", "average", "place")


# Pairs of classes: copies aren't written out

_MEMBERS = """c AS (SELECT {within} submission_id, list_sort(list(hash)) AS hs FROM sets GROUP BY ALL),
members AS (SELECT {within} submission_id, min(submission_id) OVER w AS rep, count(*) OVER w AS members FROM c WINDOW w AS (PARTITION BY {within} hs)),
own AS (SELECT {within} rep, members, hash FROM members JOIN sets USING ({within} submission_id) WHERE submission_id = rep),
class_pairs AS (SELECT {x} x.rep AS a, y.rep AS b, x.members AS n_a, y.members AS n_b, count(*) AS shared FROM own x JOIN own y ON {on} x.hash = y.hash WHERE x.rep < y.rep OR x.rep = y.rep AND x.members > 1 GROUP BY ALL)"""
_WITHIN = _MEMBERS.format(within="assignment_id,", x="x.assignment_id,", on="x.assignment_id = y.assignment_id AND")
_ACROSS = _MEMBERS.format(within="", x="", on="")


@query(f"{CODE}, {_WITHIN} SELECT * FROM class_pairs")
def candidate_classes(spark, sf):
    sets = kept(_code_arrays(spark, sf))
    return pr.class_pairs(sets, kept(pr.class_members(sets)))


@query(f"{CODE}, {_WITHIN} SELECT * FROM members")
def candidate_members(spark, sf):
    return pr.class_members(_code_arrays(spark, sf))


@query(f"{PROSE}, {_ACROSS} SELECT * FROM class_pairs")
def corpus_classes(spark, sf):
    sets = kept(_prose_arrays(spark, sf))
    return pr.class_pairs(sets, kept(pr.class_members(sets, None)), None)


# Scores of a scorer that the caller brings


def _length_ratio(batches):
    """A scorer of this module: how far the shorter prompt goes into the longer one."""
    for batch in batches:
        a, b = batch["prompt_a"].str.len(), batch["prompt_b"].str.len()
        yield a.where(a < b, b) / a.where(a > b, b)


@query(f"""{LATEST}, p AS (SELECT submission_id, length(CASE WHEN length(code) > 3000 THEN code[1:3000] || chr(10) || '[cut]' ELSE code END) AS n FROM latest)
SELECT adj.assignment_id, a, b, adjusted, CASE WHEN adjusted >= 0.7::DOUBLE * 0.5::DOUBLE THEN least(x.n, y.n)::DOUBLE / greatest(x.n, y.n) END AS semantic FROM adj JOIN p x ON x.submission_id = a JOIN p y ON y.submission_id = b""")
def scored_pairs(spark, sf):
    """Pairs past the gate go to the scorer with their prompts, and its scores come back to all pairs."""
    latest = _latest(spark, sf)
    results = _results_of(latest)
    prompt = lambda s: latest.select(F.col("submission_id").alias(s), it.prompt_text(F.col("code")).alias(f"prompt_{s}"))
    gated = it.semantic_candidates(results, F.lit(0.5)).select("assignment_id", "a", "b").join(prompt("a"), "a").join(prompt("b"), "b")
    scores = it.score_pairs(gated, _length_ratio).select("assignment_id", "a", "b", "semantic_score")
    return it.semantic_merge(results, scores, ["assignment_id", "a", "b"]).select("assignment_id", "a", "b", "adjusted", "semantic")


# Long texts


@query(f"""{PROSE}, close AS (SELECT c.assignment_id, a, b FROM cand c JOIN sizes x ON x.submission_id = a JOIN sizes y ON y.submission_id = b WHERE shared >= 0.4::DOUBLE * (x.size + y.size - shared)),
n AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT assignment_id, a, b, x.n AS lines_a, y.n AS lines_b, true AS alike, true AS in_order FROM close JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b""")
def long_pair_diff(spark, sf):
    """The line scripts of close texts, summed up: they use every line of either side once, in order, and pair only lines that are alike.

    A script goes by the texts alone, so copies have one: each two different texts are compared once.
    """
    from pyspark.sql.window import Window

    texts = src.prose(spark, sf)
    pairs = kept(pr.jaccard(pr.pair_counts(_prose_arrays(spark, sf))).where("score >= 0.4").select("assignment_id", "a", "b"))
    named = texts.select("assignment_id", "submission_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("name"))
    paired = pairs.select("assignment_id", F.explode(F.array("a", "b")).alias("submission_id")).distinct()
    same = kept(named.join(paired.hint("merge"), ["assignment_id", "submission_id"]).withColumn("rep", F.min("submission_id").over(Window.partitionBy("assignment_id", "name"))).drop("name"))
    rep = lambda s: same.select("assignment_id", F.col("submission_id").alias(s), F.col("rep").alias(f"rep_{s}")).hint("merge")
    told = kept(pairs.join(rep("a"), ["assignment_id", "a"]).join(rep("b"), ["assignment_id", "b"]))
    firsts = same.select("assignment_id", F.col("rep").alias("submission_id")).distinct()
    lines = kept(ld.numbered_lines(texts.join(firsts.hint("merge"), ["assignment_id", "submission_id"], "left_semi")), 16)
    ops = kept(ld.long_diff(kept(told.select("assignment_id", F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()), lines))
    seq = Window.partitionBy(*ld.PAIR).orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)
    next_to = lambda s: F.coalesce(F.col(f"{s}_start") == F.coalesce(F.max(f"{s}_end").over(seq), F.lit(0)) + 1, F.lit(True))
    checked = ops.withColumn("in_order", next_to("a") & next_to("b"))
    n = lambda s: F.sum(F.coalesce(F.col(f"{s}_end") - F.col(f"{s}_start") + 1, F.lit(0))).cast("long").alias(f"lines_{s}")
    sums = checked.groupBy(*ld.PAIR).agg(n("a"), n("b"), F.every("in_order").alias("in_order"))
    equal = ops.where("type = 'equal'").select(*ld.PAIR, F.explode(F.sequence(F.lit(0), F.col("a_end") - F.col("a_start"))).alias("k"), "a_start", "b_start")
    line_of = lambda s: lines.select("assignment_id", F.col("submission_id").alias(s), F.col("no").alias(f"no_{s}"), F.col("line").alias(f"line_{s}")).hint("merge")
    placed = equal.select(*ld.PAIR, (F.col("a_start") + F.col("k") - 1).cast("long").alias("no_a"), (F.col("b_start") + F.col("k") - 1).cast("long").alias("no_b"))
    alike = placed.join(line_of("a"), ["assignment_id", "a", "no_a"]).join(line_of("b"), ["assignment_id", "b", "no_b"]).groupBy(*ld.PAIR).agg(F.every(F.col("line_a") == F.col("line_b")).alias("alike"))
    facts = sums.join(alike.hint("merge"), list(ld.PAIR), "left").select("assignment_id", F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "lines_a", "lines_b", F.coalesce("alike", F.lit(True)).alias("alike"), "in_order")
    return told.join(facts.hint("merge"), ["assignment_id", "rep_a", "rep_b"]).select(*ld.PAIR, "lines_a", "lines_b", "alike", "in_order")

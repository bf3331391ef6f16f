"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import few_files, has_data, new_folder
from . import textkit as tk
from .textkit import durable, read


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds in their order, each with its pattern, the group whose length counts, and the least length.
_NAMES = "|".join(_either(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
BASE = {
    "assign": (rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
EXTRA = {
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}
#: Rule sets by version. A changed rule gets a new version, and then only that version is scanned again.
RULES = {"base-1": BASE, "extra-1": EXTRA}
KINDS = [*BASE, *EXTRA]
LEDGER = "blob string, rule_version string, findings array<struct<start: long, kind_no: int, end: long>>"
#: A text without any of these (in lower case) has no match of the kind.
_NEEDLES = {"assign": ("passw", "secret", "token", "api_key", "apikey"), "access": ("akia",), "github": ("gh",), "slack": ("xox",), "pem": ("private key",)}


def scan_text(text: str, rules: dict) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every finding, sorted; offsets are code points.

    Matches are leftmost and don't overlap within a kind; those too short are
    dropped after they were matched.
    """
    found, low = [], text.lower()
    for kind, (pattern, group, least) in rules.items():
        if kind not in _NEEDLES or any(x in low for x in _NEEDLES[kind]):
            if kind == "hex":  # runs are maximal, so short ones needn't be listed first
                pattern = r"[0-9a-f]{16,}"
            found += [(m.start(), KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _blob() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def path_index(documents: DataFrame) -> DataFrame:
    """Every path (doc_id) with the content address of its text."""
    return documents.select("doc_id", _blob().alias("blob"))


def scan_unseen(documents: DataFrame, ledger: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """Ledger rows of the blob and rule-version pairs that the ledger lacks; each blob's text is scanned once.

    Copies meet on their content address; they are cut to one per task before
    the shuffle. The ledger's versions come to the blobs by the same
    partitioning, so texts move once.
    """
    rules = RULES if rules is None else rules
    blobs = documents.select(_blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*map(F.lit, rules))
    if ledger is None:
        todo = blobs.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for blob, text, versions in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = text.as_py()
                for version in versions:
                    rows[0].append(blob)
                    rows[1].append(version)
                    rows[2].append([dict(zip(("start", "kind_no", "end"), x, strict=True)) for x in scan_text(body, rules[version])])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], kind)], names=["blob", "rule_version", "findings"])

    return todo.select("blob", "text", "todo").mapInArrow(tk.lean(scan), LEDGER)


def update_ledger(documents: DataFrame, path: str, rules: dict | None = None) -> DataFrame:
    """The ledger stored in the folder path, after what it lacked for these documents has been scanned and added.

    A run that breaks off adds nothing, and one that is repeated finds its
    pairs there and scans nothing; pairs that two runs at once added hold the
    same findings, which findings_by_path() merges.
    """
    spark = documents.sparkSession
    stored = spark.read.schema(LEDGER).parquet(path) if has_data(spark, path) else None
    few_files(scan_unseen(documents, stored, rules), 16).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings_by_path(index: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, blob, findings of all rule versions sorted by start, then kind; one row per row of the index."""
    merged = durable(ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings")))
    return index.join(merged, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<start: long, kind_no: int, end: long>>")))


def _count(kind_no: int) -> Column:
    return F.size(F.filter("findings", lambda s: s["kind_no"] == kind_no)).cast("long")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["kind_no"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan_secrets(documents: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Findings of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob.

    ledger_path: folder of the ledger of earlier runs; what it holds is not
    scanned again, and what is scanned now is added to it. Without one, a new
    ledger is made beside the checkpoints. Null texts are empty; repeated rows
    each keep theirs; a null doc_id is kept; columns other than doc_id and
    text are not read.
    """
    ledger = update_ledger(documents, ledger_path or new_folder(documents.sparkSession, "ledger"))
    found = findings_by_path(path_index(documents), ledger.where(F.col("rule_version").isin(*RULES)))
    base = F.filter("findings", lambda s: s["kind_no"] < len(BASE))
    return found.select(
        "doc_id",
        *(_count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
        "blob",
    )


def op9_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    rules = ", ".join(f"({no}, '{kind}', '{quote((BASE | EXTRA)[kind][0])}', {(BASE | EXTRA)[kind][1]}, {(BASE | EXTRA)[kind][2]})" for no, kind in enumerate(KINDS))
    # each match is put between two private-use characters; the text is cut there, so every second part is a match
    each = " UNION ALL ".join(
        f"SELECT r, {no} AS kind_no, string_split_regex(regexp_replace(text, '{quote((BASE | EXTRA)[kind][0])}', chr(57344) || '\\0' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS parts FROM d"
        for no, kind in enumerate(KINDS)
    )
    long_enough = " ".join(f"WHEN {no} THEN length(regexp_extract(part, '{quote((BASE | EXTRA)[kind][0])}', {(BASE | EXTRA)[kind][1]})) >= {(BASE | EXTRA)[kind][2]}" for no, kind in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
rules(kind_no, kind, pattern, grp, least) AS (VALUES {rules}),
cut AS ({each}),
parts AS (SELECT r, kind_no, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM cut WHERE len(parts) > 1),
placed AS (SELECT r, kind_no, part, i, coalesce(sum(length(part)) OVER (PARTITION BY r, kind_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts),
found AS (SELECT r, p.kind_no, kind, start, kind || ':' || start || ':' || (start + length(part)) AS span FROM placed p JOIN rules USING (kind_no)
  WHERE i % 2 = 1 AND CASE p.kind_no {long_enough} END),
agg AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN agg USING (r)
"""


SQL = {"op9_secret_blob_ledger": _sql()}
QUERIES = {"op9_secret_blob_ledger": op9_secret_blob_ledger}

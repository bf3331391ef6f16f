"""Files, archives and mappings as submissions, and sinks for results."""

from __future__ import annotations

import io
import itertools
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intake import base_name, dotted_extension, ext_language, safe_path
from .durable import has_data, spread


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def ingest_files(files: DataFrame) -> DataFrame:
    """path, file_name, ext, language, code of files (path, content) with a known extension and code that isn't blank; bytes are read as UTF-8."""
    named = files.select("path", base_name(F.col("path")).alias("file_name"), F.try_validate_utf8(F.col("content").cast("string")).alias("code"))
    kept = named.withColumns({"ext": dotted_extension(F.col("path")), "language": ext_language(F.col("path"))}).where("language IS NOT NULL AND trim(code) <> ''")
    return kept.select("path", "file_name", "ext", "language", "code")


#: Bytes of an entry, unpacked, that are read; larger ones are reported.
MAX_ENTRY = 50 << 20


#: Rows and bytes of content that a batch of entries holds, if one entry isn't more.
_BATCH_ROWS, _BATCH_BYTES = 1000, 8 << 20


def in_batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], content: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches; content is the column whose bytes bound them."""
    some, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for row in rows:
        some.append(row)
        size += len(row[content] or b"") if content is not None else 0
        if len(some) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


ENTRY = {"path": pa.string(), "entry": pa.string(), "content": pa.binary(), "error": pa.string()}


def archive_entries(archives: DataFrame, max_entry: int = MAX_ENTRY) -> DataFrame:
    """path (archive!entry), entry, content, error of every file in ZIP archives (path, content), entry by entry.

    What can't be read has a row without content that says why: an archive
    that is broken or null (without entry), an entry that is encrypted,
    damaged, or larger than max_entry bytes.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    yield path, None, None, f"archive: {e}"
                    continue
                with archive:
                    for info in archive.infolist():
                        if info.is_dir():
                            continue
                        name = f"{path}!{info.filename}"
                        if info.file_size > max_entry:
                            yield name, info.filename, None, f"entry: {info.file_size} bytes"
                            continue
                        try:
                            yield name, info.filename, archive.read(info), None
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
                            yield name, info.filename, None, f"entry: {e}"

    return archives.select("path", "content").mapInArrow(lambda batches: in_batches(entries(batches), ENTRY, 2), "path string, entry string, content binary, error string")


def ingest_archives(archives: DataFrame) -> DataFrame:
    """ingest_files() of the entries of ZIP archives (path, content) that can be read; path is archive!entry. Unsafe names are passed over; archive_errors() has the rest."""
    entries = archive_entries(archives).where("error IS NULL")
    return ingest_files(entries.where(safe_path(F.col("entry"))).select("path", "content"))


def archive_errors(archives: DataFrame) -> DataFrame:
    """path, error of the archives and entries that can't be read."""
    return archive_entries(archives).where("error IS NOT NULL").select("path", "error")


def inline_files(texts: DataFrame) -> DataFrame:
    """(path, content) of texts given as such (path, text), to be united with read_files()."""
    return texts.select("path", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def zip_files(files: DataFrame) -> DataFrame:
    """(path, content) of one archive for each value of archive, with its files (archive, path, content); a task builds one archive after the other, so each must fit it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for name, group in itertools.groupby(rows, key=lambda row: row[0]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for _, path, content in group:
                    archive.writestr(path, content)
            yield name, out.getvalue()

    dealt = spread(files.select("archive", "path", "content"), "archive").sortWithinPartitions("archive", "path")
    return dealt.mapInArrow(lambda batches: in_batches(pack(batches), {"path": pa.string(), "content": pa.binary()}, 1), "path string, content binary")


def csv_mapping(lines: DataFrame) -> DataFrame:
    """file_name (lower case), student_id, student_name of lines (line_no, line): id,name,file or id,file; the last line of a file name wins.

    Blank lines and those that begin with student_id are no mapping.
    """
    trimmed = lines.select("line_no", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(lower(line), 'student_id')")
    parts = trimmed.select("line_no", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("p"))
    three = F.size("p") >= 3
    named = parts.where(F.size("p") >= 2).select(
        "line_no", F.lower(F.when(three, F.try_element_at("p", F.lit(3))).otherwise(F.col("p")[1])).alias("file_name"), F.col("p")[0].alias("student_id"), F.when(three, F.col("p")[1]).otherwise(F.col("p")[0]).alias("student_name")
    )
    last = F.max_by(F.struct("student_id", "student_name"), "line_no").alias("last")
    return named.where("file_name <> ''").groupBy("file_name").agg(last).select("file_name", "last.student_id", "last.student_name")


def identify_students(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """files (path, ...) with student_id and student_name from the mapping, else the file's name without extension."""
    name = base_name(F.col("path"))
    stem: Column = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    joined = files.withColumn("file_name", F.lower(name)).join(mapping.withColumnRenamed("student_id", "known_id").withColumnRenamed("student_name", "known_name"), "file_name", "left")
    return joined.select(*(files[c] for c in files.columns), F.coalesce("known_id", stem).alias("student_id"), F.coalesce("known_name", stem).alias("student_name"))


def replace_results(results: DataFrame, path: str) -> None:
    """Write results by assignment; only the assignments that results has are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assignment_id").parquet(path)


def replace_boilerplate(stats: DataFrame, path: str) -> None:
    """Write boilerplate statistics by assignment; only the assignments that stats has are replaced."""
    replace_results(stats, path)


def add_to_index(sets: DataFrame, path: str) -> None:
    """Add (assignment_id, submission_id, hash) rows that the index doesn't hold yet."""
    spark = sets.sparkSession
    new = sets.select("assignment_id", "submission_id", "hash").distinct()
    if has_data(spark, path):
        new = new.join(spark.read.schema("assignment_id string, submission_id long, hash long").parquet(path), ["assignment_id", "submission_id", "hash"], "left_anti")
    new.write.mode("append").parquet(path)

"""ZIP archives as a Spark data source: one archive is read by several tasks, each by ranges of its own."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .durable import spread
from .ingest import ENTRY, MAX_ENTRY, in_batches

#: Packed bytes and entries that one task reads.
TASK_BYTES, TASK_ENTRIES = 16 << 20, 1000
_LOCAL_HEADER = struct.Struct("<4s5H3I2H")
_PIECE = 1 << 20
#: Files that write_archives() puts into one folder.
_FOLDER_FILES = 10_000


@dataclass(frozen=True)
class Entry:
    """What the central directory says of a file."""

    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    flags: int


@dataclass
class EntryRange:
    """Entries of one archive; without entries, why the archive can't be read."""

    path: str
    entries: tuple[Entry, ...] = ()
    error: str | None = None


@dataclass
class Bundle(InputPartition):
    """What one task reads: a range of a large archive, or small ones together."""

    ranges: tuple[EntryRange, ...]


def _open(path: str):
    """A file of any store that pyarrow knows, read by ranges."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def plan_ranges(path: str, task_bytes: int = TASK_BYTES, task_entries: int = TASK_ENTRIES) -> Iterator[EntryRange]:
    """The entries of an archive in the order of their bytes, as many a range as a task takes; only the central directory is read."""
    try:
        with _open(path) as f, zipfile.ZipFile(f) as archive:
            infos = sorted((i for i in archive.infolist() if not i.is_dir()), key=lambda i: i.header_offset)
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        yield EntryRange(path, (), f"archive: {e}")
        return
    some, size = [], 0
    for i in infos:
        if some and (size + i.compress_size > task_bytes or len(some) >= task_entries):
            yield EntryRange(path, tuple(some))
            some, size = [], 0
        some.append(Entry(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits))
        size += i.compress_size
    if some:
        yield EntryRange(path, tuple(some))


def read_entry(f, entry: Entry, max_entry: int) -> bytes:
    """The unpacked bytes of an entry, of which no more than max_entry are ever held; ValueError says what is wrong with it."""
    if entry.size > max_entry:
        raise ValueError(f"{entry.size} bytes")
    if entry.flags & 1:
        raise ValueError("encrypted")
    if entry.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression {entry.method}")
    f.seek(entry.offset)
    head = f.read(_LOCAL_HEADER.size)
    if len(head) < _LOCAL_HEADER.size or head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    *_, name, extra = _LOCAL_HEADER.unpack(head)
    f.seek(entry.offset + _LOCAL_HEADER.size + name + extra)
    unpack = zlib.decompressobj(-15) if entry.method == zipfile.ZIP_DEFLATED else None
    out, left = bytearray(), entry.packed
    while left:
        piece = f.read(min(left, _PIECE))
        if not piece:
            raise ValueError("the archive ends within it")
        left -= len(piece)
        try:
            out += unpack.decompress(piece, max_entry + 1 - len(out)) if unpack else piece
        except zlib.error as e:
            raise ValueError(str(e)) from None
        if len(out) > max_entry:
            raise ValueError(f"more than {max_entry} bytes")
    if len(out) != entry.size or zlib.crc32(out) != entry.crc:
        raise ValueError("bad checksum")
    return bytes(out)


def read_range(part: EntryRange, archive: str, max_entry: int) -> Iterator[tuple]:
    """path (archive!entry), entry, content, error of the entries of a range."""
    if part.error:
        yield archive, None, None, part.error
        return
    with _open(part.path) as f:
        for entry in part.entries:
            name = f"{archive}!{entry.name}"
            try:
                yield name, entry.name, read_entry(f, entry, max_entry), None
            except (ValueError, OSError) as e:
                yield name, entry.name, None, f"entry: {e}"


def bundles(ranges: Iterator[EntryRange], task_bytes: int, task_entries: int) -> Iterator[Bundle]:
    """Ranges in their order, as many together as a task takes."""
    some, size, n = [], 0, 0
    for r in ranges:
        packed, entries = sum(e.packed for e in r.entries), max(1, len(r.entries))
        if some and (size + packed > task_bytes or n + entries > task_entries):
            yield Bundle(tuple(some))
            some, size, n = [], 0, 0
        some.append(r)
        size, n = size + packed, n + entries
    if some:
        yield Bundle(tuple(some))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.max_entry = int(options.get("maxentry", MAX_ENTRY))
        self.task_bytes, self.task_entries = int(options.get("taskbytes", TASK_BYTES)), int(options.get("taskentries", TASK_ENTRIES))

    def partitions(self) -> list[Bundle]:
        ranges = (r for p in self.paths for r in plan_ranges(p, self.task_bytes, self.task_entries))
        return list(bundles(ranges, self.task_bytes, self.task_entries))

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for part in partition.ranges:
            yield from read_range(part, part.path, self.max_entry)


class ZipEntries(DataSource):
    """Format zip_entries: path (archive!entry), entry, content, error of every file in ZIP archives.

    Options: path (one, or several on lines of their own), maxEntry, taskBytes,
    taskEntries. The archives' central directories are read to plan the tasks;
    each task then seeks to its own entries, one at a time. Archives and
    entries that can't be read are rows with an error. The archives must be in
    a store that pyarrow reaches from every executor; archive_entries() takes
    the bytes of archives from any store of Spark's instead.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "path string, entry string, content binary, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, paths: list[str], **options: int) -> DataFrame:
    """The entries of these archives, as ZipEntries gives them."""
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").options(path="\n".join(paths), **options).load()


def write_archives(archives: DataFrame, folder: str) -> DataFrame:
    """archive, file: write each (path, content) of archives as a file of its own below folder, from the tasks that hold it; path is called archive, file is where it is.

    A task's files are in a folder of their own, so an attempt that runs again
    leaves those of the first one alone. To be kept, as each use writes anew.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        own, n = uuid.uuid4().hex, 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n % _FOLDER_FILES == 0:
                    store.create_dir(f"{place}/{own}/{n // _FOLDER_FILES}")
                with store.open_output_stream(f"{place}/{own}/{n // _FOLDER_FILES}/{n}.zip") as out:
                    out.write(content.as_py())
                yield name, f"{folder}/{own}/{n // _FOLDER_FILES}/{n}.zip"
                n += 1

    kinds = {"archive": pa.string(), "file": pa.string()}
    return archives.select("path", "content").mapInArrow(lambda batches: in_batches(write(batches), kinds), "archive string, file string")


_ENTRIES = "array<struct<name: string, offset: bigint, packed: bigint, size: bigint, crc: bigint, method: int, flags: int>>"
_ENTRY_KINDS = pa.struct([("name", pa.string()), *((c, pa.int64()) for c in ("offset", "packed", "size", "crc")), ("method", pa.int32()), ("flags", pa.int32())])


def read_stored(stored: DataFrame, max_entry: int = MAX_ENTRY, task_bytes: int = TASK_BYTES, task_entries: int = TASK_ENTRIES) -> DataFrame:
    """path (archive!entry), entry, content, error of every file in the archives of a table (archive, file), as ZipEntries gives them.

    Tasks plan the ranges from the archives' central directories, and the
    ranges are dealt over other tasks, which read them. The driver sees no
    names, however many archives there are.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, part in enumerate(plan_ranges(file, task_bytes, task_entries)):
                    yield name, file, number, [asdict(e) for e in part.entries], part.error

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, file, _, entries, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from read_range(EntryRange(file, tuple(Entry(**e) for e in entries), error), name, max_entry)

    kinds = {"archive": pa.string(), "file": pa.string(), "number": pa.int32(), "entries": pa.list_(_ENTRY_KINDS), "error": pa.string()}
    ranges = stored.select("archive", "file").mapInArrow(lambda batches: in_batches(plan(batches), kinds), f"archive string, file string, number int, entries {_ENTRIES}, error string")
    return spread(ranges, "file", "number").mapInArrow(lambda batches: in_batches(read(batches), ENTRY, 2), "path string, entry string, content binary, error string")


def write_files(files: DataFrame, folder: str) -> list[str]:
    """Write each (name, content) of files as a file of its own, from the tasks that hold it; the paths, sorted."""

    def write(rows) -> None:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        store.create_dir(place)
        for name, content in rows:
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(content)

    files.select(F.col("name"), F.col("content")).foreachPartition(write)
    return sorted(f"{folder}/{r.name}" for r in files.select("name").collect())

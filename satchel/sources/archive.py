"""spark.read.format("archive") and df.write.format("archive").

Reading: one row a member in document order. Options: content (default true)
reads and inflates member bytes; base (default 12) is the number of bytes
between the end of what the header counts and its start; split (bytes of data
and directory, default 64 MB) divides large archives between tasks. A directory
has no entry points, so one task goes through it first and cuts it; after that
each task parses its own stretch. read_archive() does this by a job, a task for
each archive, and hands the cuts over (option cuts); without them, or if a file
has changed since, the driver goes through the directory. With option pushdown (and the session's
spark.sql.python.filterPushdown.enabled) filters on path, is_dir and unpacked
are taken by the reader, so that bytes of other members are not read.

Writing: rows (path, content, and optionally is_dir, executable, unpacked,
size) become one archive. Options: kind (asar, bsar or baz, by suffix
otherwise), compress, integrity. Tasks hash, compress and spool their members
side by side, with sorted runs of encoded entries beside them; the commit
merges the runs by path segments, lays out offsets and joins the spools. An
archive is one file by its format, so the last step has one writer; it holds a
batch of each run, never the directory.

Paths are of any file system that pyarrow opens.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import io
import os
import pickle
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from satchel import schema as S
from satchel.operators.codec import deflate_bytes, inflate_bytes
from satchel.sources.directory import ArchiveError, Entry, words
from satchel.sources.scan import DirectoryWriter, Place, Scan, encoded, open_directory, rank, read_directory

STRETCH = struct.Struct("<IQQ")
SPLIT = 64 << 20
SUFFIXES = {".asar": "asar", ".bsar": "bsar", ".baz": "bsar"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def list_archives(path: str) -> list[tuple[str, int]]:
    """Files with a known suffix below a folder, or the file itself, with sizes."""
    fs, p = file_system(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
    return sorted((path.rstrip("/") + x.path[len(p.rstrip("/")) :], x.size) for x in found if x.type == pafs.FileType.File and os.path.splitext(x.path)[1] in SUFFIXES)


@dataclass
class Cut:
    """A stretch of a directory: where it begins, its number of entries, where member data start."""

    place: Place
    entries: int
    base: int


def cuts(archive: str, base_shift: int, split: int) -> list[Cut]:
    """Stretches of `split` bytes of data and directory, by one pass; a part for each `split` bytes of the file, so
    some are empty if members are longer."""
    fs, p = file_system(archive)
    with fs.open_input_file(p) as f:
        scan, base = open_directory(f, base_shift)
        out, begun, held = [Cut(scan.place(), 0, base)], scan.at, 0
        for e in scan:
            out[-1].entries += 1
            if not e.is_dir and not e.unpacked:
                held += e.size or 0
            here = scan.at + scan.pos
            if held + here - begun >= split:
                out.append(Cut(scan.place(), 0, base))
                begun, held = here, 0
    return out + [Cut(scan.place(), 0, base)] * (1 + fs.get_file_info(p).size // split - len(out))


def stamps(archives: list[str]) -> list[tuple[int, int]]:
    """Sizes and times of change."""
    by_name = [file_system(a) for a in archives]
    return [(x.size, x.mtime_ns or 0) for x in by_name[0][0].get_file_info([p for _, p in by_name])] if archives else []


@dataclass
class Part(InputPartition):
    archive: str
    cut: Cut | None  # None: the whole archive


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, content: bool) -> None:
        self.path, self.content = options["path"], content
        self.base = int(options.get("base", 12))
        self.split = int(options.get("split", SPLIT))
        self.cuts = options.get("cuts")
        self.equal: dict[str, object] = {}

    def partitions(self) -> list[Part]:
        found = list_archives(self.path)
        large = [a for a, size in found if self.content and size >= self.split]
        known: dict = {}
        if self.cuts and large:
            with open(self.cuts, "rb") as f:  # the driver's own file
                known = pickle.load(f)
        made = {a: known[a, stamp] if (a, stamp) in known else cuts(a, self.base, self.split) for a, stamp in zip(large, stamps(large), strict=True)}
        return [Part(a, c) for a, _ in found for c in made.get(a, [None])]

    def read(self, part: Part) -> Iterator[tuple]:
        fs, p = file_system(part.archive)
        with fs.open_input_file(p) as f:
            if part.cut is None:
                entries, base = open_directory(f, self.base)
            else:
                entries, base = islice(Scan.resume(f, part.cut.place), part.cut.entries), part.cut.base
            for e in entries:
                if any(getattr(e, k) != v for k, v in self.equal.items()):
                    continue
                if not self.content:
                    yield e.row(part.archive)
                elif e.is_dir or e.unpacked:
                    yield (*e.row(part.archive), None)
                else:
                    f.seek(base + (e.offset or 0))
                    data = f.read(e.size or 0)
                    if len(data) != (e.size or 0):
                        raise ArchiveError(f"{e.path}: data end early")
                    yield (*e.row(part.archive), inflate_bytes(data) if e.compression else data)


class FilteringReader(ArchiveReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; others refuse a reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("is_dir",), ("unpacked",)) and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f


#: Entries and bytes of a sorted run at most, entries that are read of a run at once, runs that are merged and spools that are open at once.
RUN, RUN_BYTES, BATCH, FAN = 1 << 16, 32 << 20, 256, 128


@dataclass
class Spool(WriterCommitMessage):
    runs: list[str]


#: path segments, rank, spool, start and size of its data there (start None: no data), encoded attributes before and after the offset
Record = tuple[list[str], int, str, int | None, int, bytes, bytes | None]


def record_order(r: Record) -> tuple[list[str], int]:
    return r[0], r[1]


def write_run(fs: pafs.FileSystem, name: str, records: Iterator[Record]) -> str:
    with fs.open_output_stream(name) as out:
        while batch := list(islice(records, BATCH)):
            data = pickle.dumps(batch)
            out.write(struct.pack("<Q", len(data)) + data)
    return name


def read_run(fs: pafs.FileSystem, name: str) -> Iterator[Record]:
    with fs.open_input_stream(name) as f:
        while size := f.read(8):
            yield from pickle.loads(f.read(struct.unpack("<Q", size)[0]))


def merged(fs: pafs.FileSystem, folder: str, runs: list[str]) -> Iterator[Record]:
    """All records in order, equal ones as their runs stand; more than FAN runs become fewer first."""
    while len(runs) > FAN:
        runs = [write_run(fs, f"{folder}/{uuid.uuid4().hex}", heapq.merge(*(read_run(fs, r) for r in runs[i : i + FAN]), key=record_order)) for i in range(0, len(runs), FAN)]
    return heapq.merge(*(read_run(fs, r) for r in runs), key=record_order)


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        kind = options.get("kind") or SUFFIXES.get(os.path.splitext(self.path)[1], "bsar")
        if kind not in ("asar", "bsar", "baz"):
            raise ValueError(f"unknown kind of archive: {kind}")
        self.bson = kind != "asar"
        self.compress = str(options.get("compress", "false")).lower() in ("true", "deflate")
        self.integrity = str(options.get("integrity", "false")).lower() in ("true", "sha256")
        folder, slash, name = self.path.rpartition("/")
        self.spools = f"{folder}{slash}_{name}.spool-{uuid.uuid4().hex}"  # readers of the folder skip such names

    def write(self, rows: Iterator) -> Spool:
        fs, top = file_system(self.spools)
        fs.create_dir(top, recursive=True)
        name = f"{top}/{uuid.uuid4().hex}"
        runs: list[str] = []
        records: list[Record] = []
        at = held = 0

        def run() -> None:
            records.sort(key=record_order)
            runs.append(write_run(fs, f"{name}.{len(runs)}", iter(records)))
            records.clear()

        with fs.open_output_stream(name) as out:
            for r in rows:
                v = dict(zip(self.columns, r, strict=True))
                e = Entry(v["path"], bool(v.get("is_dir")), executable=bool(v.get("executable")), unpacked=bool(v.get("unpacked")))
                content, start = v.get("content"), None
                if not e.is_dir:
                    data = b"" if content is None else bytes(content)
                    e.size = len(data) if content is not None else int(v.get("size") or 0)
                    if not e.unpacked:
                        if self.integrity:
                            e.algorithm, e.hash, e.block_size = S.SHA256, hashlib.sha256(data).digest(), S.BLOCK
                            e.blocks = [hashlib.sha256(data[i : i + S.BLOCK]).digest() for i in range(0, len(data) // S.BLOCK * S.BLOCK + 1, S.BLOCK)]
                        if self.compress:
                            e.compression, e.original_size = S.DEFLATE, len(data)
                            data = deflate_bytes(data)
                            e.size = len(data)
                        out.write(data)
                        start = at
                        at += len(data)
                head, tail = (b"", None) if e.is_dir else encoded(e, self.bson)
                records.append((e.path.split("/"), rank(e), name, start, e.size or 0, head, tail))
                held += len(head) + len(tail or b"")
                if len(records) >= RUN or held >= RUN_BYTES:
                    run()
                    held = 0
            run()
        return Spool(runs)

    def commit(self, messages: list[Spool | None]) -> None:
        fs, target = file_system(self.path)
        if not self.overwrite and fs.get_file_info(target).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)
        done, top = (file_system(f"{self.spools}{x}")[1] for x in ("-done", ""))
        # The driver's own files: the directory, and which stretch of which spool comes next.
        with tempfile.TemporaryFile() as body, tempfile.TemporaryFile() as plan, fs.open_output_stream(done) as out:
            numbers = self._lay_out(merged(fs, top, [r for m in messages if m for r in m.runs]), body, plan)
            before, after = words(body.seek(0, os.SEEK_END), self.bson)
            out.write(before)
            body.seek(0)
            while block := body.read(S.BLOCK):
                out.write(block)
            out.write(after)
            self._join(fs, plan, list(numbers), out)
        fs.move(done, target)
        self._clean(fs)

    def _lay_out(self, records: Iterator[Record], body: BinaryIO, plan: BinaryIO) -> dict[str, int]:
        """Writes the directory and the plan; the numbers of spools in the plan."""
        directory, numbers = DirectoryWriter(body, self.bson), {}
        at, last = 0, (0, 0, 0)  # number, start and size of a stretch
        for segments, kind, spool, start, size, head, tail in records:
            directory.add("/".join(segments), kind, head, tail, at)
            if start is None:
                continue
            number = numbers.setdefault(spool, len(numbers))
            if (number, start) == (last[0], last[1] + last[2]):
                last = (*last[:2], last[2] + size)
            else:
                plan.write(STRETCH.pack(*last))
                last = (number, start, size)
            at += size
        plan.write(STRETCH.pack(*last))
        directory.close()
        return numbers

    def _join(self, fs: pafs.FileSystem, plan: BinaryIO, spools: list[str], out: pa.NativeFile) -> None:
        files: dict[int, pa.NativeFile] = {}
        plan.seek(0)
        while stretches := plan.read(STRETCH.size << 12):
            for number, start, left in STRETCH.iter_unpack(stretches):
                if not left:
                    continue
                if number not in files:
                    if len(files) >= FAN:
                        files.pop(next(iter(files))).close()
                    files[number] = fs.open_input_file(spools[number])
                f = files[number]
                f.seek(start)
                while left:
                    block = f.read(min(left, S.BLOCK))
                    if not block:
                        raise ArchiveError(f"{spools[number]}: spooled data end early")
                    out.write(block)
                    left -= len(block)
        for f in files.values():
            f.close()

    def abort(self, messages: list[Spool | None]) -> None:
        self._clean(file_system(self.spools)[0])

    def _clean(self, fs: pafs.FileSystem) -> None:
        top = file_system(self.spools)[1]
        if fs.get_file_info(top).type == pafs.FileType.Directory:
            fs.delete_dir(top)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def _content(self) -> bool:
        return str(self.options.get("content", "true")).lower() == "true"

    def schema(self) -> StructType:
        return S.WITH_CONTENT if self._content() else S.MEMBER

    def reader(self, schema: StructType) -> ArchiveReader:
        pushes = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteringReader if pushes else ArchiveReader)(dict(self.options), len(schema) == len(S.WITH_CONTENT))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    from satchel.session import ship
    from satchel.sources.files import FileTreeSource

    ship(spark)
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(FileTreeSource)


def _cut(spark: SparkSession, path: str, base: int, split: int) -> str | None:
    """A file of the driver with the cuts of large archives below path, made on executors; None if there are none."""
    large = [a for a, size in list_archives(path) if size >= split]
    if not large:
        return None
    seen = stamps(large)
    made = spark.sparkContext.parallelize(large, min(len(large), 10_000)).map(lambda a: cuts(a, base, split)).collect()
    folder = os.path.realpath(tempfile.mkdtemp(prefix="satchel-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with open(f"{folder}/cuts", "wb") as f:
        pickle.dump({(a, stamp): c for a, stamp, c in zip(large, seen, made, strict=True)}, f)
    return f.name


def read_archive(spark: SparkSession, path: str, content: bool = False, **options: str) -> DataFrame:
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    found = _cut(spark, path, int(options.get("base", 12)), int(options.get("split", SPLIT))) if content else None
    made = {"content": str(content).lower(), "pushdown": pushdown} | ({"cuts": found} if found else {})
    return spark.read.format("archive").options(**(made | options)).load(path)


def write_archive(members: DataFrame, path: str, **options: str) -> None:
    """members: path, and any of content, is_dir, executable, unpacked, size."""
    register(members.sparkSession)
    known = [c for c in ("path", "content", "is_dir", "executable", "unpacked", "size") if c in members.columns]
    members.select(*known).write.format("archive").options(**options).mode("overwrite").save(path)


def open_bytes(data: bytes) -> tuple[list[Entry], int]:
    return read_directory(io.BytesIO(data))

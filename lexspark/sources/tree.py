"""A folder of files as a Python data source: each file below it a row, each row a file.

Spark's own text reader passes over files without a byte, which a dictionary reports as its gravest fault, and its writer
names files itself.  This source gives every file and writes each row under the name that the row has.

Reading: the root is listed once, then its folders are walked by tasks, each of which reads a slice of a folder's files by
their names' checksum, so that a folder that holds most files is shared among tasks.  Names that begin with ``.`` or ``_`` are
hidden, as they are for Spark.

Writing: a task writes each file under a hidden name in its folder and then renames it, so a reader sees whole files only
and a task that is run again after a lost executor puts the same file in the same place.  Files of other names stay.

Cases: a text that isn't UTF-8 comes as null with the reason in ``corrupt``; a null text is written as an empty file; a null name,
or one that leads out of the folder, raises; of rows that share a name, one stays, whole; an empty folder gives no rows, an
absent one raises.  A file is held whole in a task's memory.  Stores are those that pyarrow knows.

Archives: a file of a few bytes takes a whole block of most stores, so a folder of millions of them takes many times their
texts.  With the option ``archives`` a task writes its files into archives (``.tar.gz``) below the root, each of a bounded
number of files and of characters, and a task reads one of them.  They are hidden until all tasks have ended, so a task that
is run again adds nothing.  Unpacked in place they are the folder.  A name that two rows share is in them twice.
"""

from __future__ import annotations

import dataclasses
import gzip
import io
import itertools
import os
import posixpath
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "lexspark_tree"
#: Tasks that share a folder.
SLICES = 8
#: Files, and characters of text, that a task reads before it hands them on.
BATCH_ROWS, BATCH_CHARS = 1000, 4_000_000
#: Files, and bytes of text, of an archive, about.
ARCHIVE_FILES, ARCHIVE_BYTES = 50_000, 64_000_000
ARCHIVE = ".tar.gz"


def store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))


@dataclasses.dataclass
class Slice(InputPartition):
    """The files of ``folder`` (and below, if ``deep``) whose name's checksum leaves ``number``."""

    folder: str
    deep: bool
    number: int

    def __hash__(self) -> int:
        return hash((self.folder, self.deep, self.number))


@dataclasses.dataclass
class Archive(InputPartition):
    """The files of one archive; of none without a path."""

    path: str | None

    def __hash__(self) -> int:
        return hash(self.path)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    files: int
    archives: tuple[str, ...] = ()


def _shown(path: str) -> bool:
    return posixpath.basename(path)[:1] not in (".", "_")


def _entries(files, folder: str) -> Iterator[tuple[str, bool, bool]]:
    """Path, whether a folder, whether a file: of a local folder one by one; pyarrow lists those of other stores whole."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for f in found:
                yield posixpath.join(folder, f.name), f.is_dir(), f.is_file()
        return
    for f in files.get_file_info(fs.FileSelector(folder)):
        yield f.path, f.type == fs.FileType.Directory, f.type == fs.FileType.File


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["file", "text", "corrupt"])


def _row(name: str, data: bytes) -> tuple:
    try:
        return name, data.decode("utf-8"), None
    except UnicodeDecodeError as wrong:
        return name, None, f"{wrong.reason} at byte {wrong.start}"


def _below(file: str | None) -> str:
    """The name that a row's file has below the root."""
    name = posixpath.normpath((file or "").lstrip("/"))
    if name in (".", "..") or name.startswith("../"):
        raise ValueError(f"not the name of a file below the folder: {file!r}")
    return name


def _given(iterator) -> Iterator[tuple[str, bytes]]:
    """Names and bytes; Arrow's values are read one at a time: a batch is never a second time in memory as rows."""
    for batch in iterator:
        for f, t in zip(batch.column("file"), batch.column("text")):
            yield _below(f.as_py()), (t.as_py() or "").encode("utf-8")


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.ending, self.slices = options["path"], options.get("ending", ""), int(options.get("slices", SLICES))

    def partitions(self) -> list[Slice]:
        from pyarrow import fs

        files, root = store(self.root)
        found = files.get_file_info(fs.FileSelector(root))
        folders = sorted(f.path for f in found if f.type == fs.FileType.Directory and _shown(f.path))
        return [Slice(folder, deep, i) for folder, deep in [(root, False), *[(f, True) for f in folders]] for i in range(self.slices)]

    def _names(self, files, part: Slice) -> Iterator[str]:
        folders = [part.folder]
        while folders:
            for path, is_folder, is_file in _entries(files, folders.pop()):
                if not _shown(path):
                    continue
                if is_folder and part.deep:
                    folders.append(path)
                elif is_file and path.endswith(self.ending) and zlib.crc32(path.encode()) % self.slices == part.number:
                    yield path

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """Batches of bounded bytes: rows would be gathered by their number alone, however long their texts."""
        held, size = [], 0
        for row in self._rows(partition):
            held.append(row)
            size += len(row[1] or "")
            if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _rows(self, partition: Slice) -> Iterator[tuple]:
        files, root = store(self.root)
        for path in self._names(files, partition):
            with files.open_input_stream(path, compression=None) as stream:
                data = stream.read()
            yield _row(posixpath.relpath(path, root), data)


class ArchiveReader(TreeReader):
    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        files, root = store(self.root)
        found = files.get_file_info(fs.FileSelector(root))
        return [Archive(f.path) for f in found if f.type == fs.FileType.File and _shown(f.path) and f.path.endswith(ARCHIVE)] or [Archive(None)]

    def _rows(self, partition: Archive) -> Iterator[tuple]:
        if partition.path is None:
            return
        files, _ = store(self.root)
        # unpacked apart: tarfile's own way with gzip copies all that a buffer unpacks to for each block it takes
        with files.open_input_stream(partition.path, compression=None) as stream, gzip.open(stream) as plain, tarfile.open(fileobj=plain, mode="r|") as archive:
            for member in archive:
                archive.members = []  # or it would keep what it has passed
                if member.isfile() and member.name.endswith(self.ending) and all(map(_shown, member.name.split("/"))):
                    yield _row(member.name, archive.extractfile(member).read())


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, iterator) -> Written:
        files, root = store(self.root)
        n, there = 0, set()
        for name, data in _given(iterator):
            to = posixpath.join(root, name)
            folder = posixpath.dirname(to)
            made = posixpath.join(folder, f".{uuid.uuid4().hex}")
            if folder not in there:
                files.create_dir(folder, recursive=True)
                there = {folder} if len(there) >= 1000 else there | {folder}
            try:
                with files.open_output_stream(made, compression=None) as stream:
                    stream.write(data)
                files.move(made, to)
            except BaseException:
                if files.get_file_info(made).is_file:
                    files.delete_file(made)
                raise
            n += 1
        return Written(n)


class ArchiveWriter(TreeWriter):
    def write(self, iterator) -> Written:
        files, root = store(self.root)
        given, made, n = _given(iterator), [], 0
        try:
            while (first := next(given, None)) is not None:
                made.append(f"{uuid.uuid4().hex}{ARCHIVE}")
                with files.open_output_stream(posixpath.join(root, f".{made[-1]}"), compression=None) as stream:
                    n += _packed(itertools.chain([first], given), stream)
        except BaseException:
            self._dropped(made)
            raise
        return Written(n, tuple(made))

    def _dropped(self, archives) -> None:
        files, root = store(self.root)
        for name in archives:
            if files.get_file_info(path := posixpath.join(root, f".{name}")).is_file:
                files.delete_file(path)

    def commit(self, messages) -> None:
        """Shows the archives of the tasks that count, and no others."""
        files, root = store(self.root)
        for name in (a for m in messages if m for a in m.archives):
            files.move(posixpath.join(root, f".{name}"), posixpath.join(root, name))

    def abort(self, messages) -> None:
        for m in messages:
            self._dropped(m.archives if m else ())


def _packed(given: Iterator[tuple[str, bytes]], stream) -> int:
    """Puts files into an archive until it is full; returns how many."""
    n = size = 0
    with gzip.open(stream, "wb", compresslevel=6) as plain, tarfile.open(fileobj=plain, mode="w|", format=tarfile.GNU_FORMAT) as archive:
        for name, data in given:
            member = tarfile.TarInfo(name)
            member.size = len(data)
            archive.addfile(member, io.BytesIO(data))
            archive.members = []
            n, size = n + 1, size + len(data)
            if n >= ARCHIVE_FILES or size >= ARCHIVE_BYTES:
                break
    return n


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, text string, corrupt string"

    def _packed(self) -> bool:
        return self.options.get("archives", "false").lower() == "true"

    def reader(self, schema) -> TreeReader:
        return (ArchiveReader if self._packed() else TreeReader)(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a folder of files takes rows by append: files of the same names are replaced, others stay")
        return (ArchiveWriter if self._packed() else TreeWriter)(self.options)


def read_tree(spark: SparkSession, root: str, ending: str = ".txt", slices: int = SLICES, archives: bool = False) -> DataFrame:
    """file (below ``root``), text and corrupt of every file whose name has ``ending``, those without a byte too."""
    spark.dataSource.register(Tree)
    return spark.read.format(NAME).option("ending", ending).option("slices", slices).option("archives", archives).load(root)


def write_tree(rows: DataFrame, root: str, archives: bool = False) -> None:
    """Each row of (file, text) as a file below ``root``, or in an archive there, by the executors."""
    rows.sparkSession.dataSource.register(Tree)
    files, path = store(root)
    files.create_dir(path, recursive=True)
    rows.select("file", "text", F.lit(None).cast("string").alias("corrupt")).write.format(NAME).option("archives", archives).mode("append").save(root)

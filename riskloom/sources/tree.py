"""The ``sourcetree`` data source: directories and zip archives as files.

    spark.dataSource.register(SourceTree)
    spark.read.format("sourcetree").load("/path/to/repo")

Unlike the built-in file sources it keeps names that start with ``.`` or ``_``, empty
files and permission bits. Options: subdir, prefix, suffixes, names, maxFiles, maxTotalBytes, maxFileBytes (of
archives), content ("false" leaves content null), directories (see below). A schema without
content opens no file at all.

A directory is listed by the tasks that read it: planning looks at the top level alone and
makes each directory there a partition. ``read_tree`` deals large trees out more finely: a
job of its own expands directories level by level, until there are enough of them, and
only their names (MAX_DIRECTORIES at most) reach the driver. Conditions on path are pushed into the
listing where the session allows it (spark.sql.python.filterPushdown.enabled, which
read_tree sets): equality, IN, and what it starts with, ends with or contains. A file that
fails one is not opened, a directory that can't hold such files is not entered.

A path that ends in .zip is read as an archive that all executors can open: its directory is
parsed once, and rejected as a whole if it holds a symbolic link, an absolute path or ``..``,
or exceeds a limit. A partition has the places of its entries and reads and
inflates those bytes only; nothing is written to disk.
"""

from __future__ import annotations

import json
import os
import stat
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, mode int, content binary"
#: Defaults of the limits on archives.
LIMITS = {"maxFiles": 30_000, "maxTotalBytes": 300 * 1024 * 1024, "maxFileBytes": 10 * 1024 * 1024}
#: Compressed bytes of an archive that a partition reads.
ARCHIVE_BYTES = 16 << 20
#: Directories whose names the driver may hold.
MAX_DIRECTORIES = 10_000


class UnsafeArchive(ValueError):
    """The archive may not be read."""


def checked_entries(archive: zipfile.ZipFile, max_files: int, max_total: int, max_file: int) -> list[zipfile.ZipInfo]:
    """The files of an archive, or UnsafeArchive."""
    entries = [e for e in archive.infolist() if not e.is_dir()]
    if len(entries) > max_files:
        raise UnsafeArchive(f"more than {max_files} files")
    total = 0
    for e in entries:
        name = e.filename.replace("\\", "/")
        parts = PurePosixPath(name)
        if stat.S_ISLNK(e.external_attr >> 16):
            raise UnsafeArchive(f"symbolic link: {name}")
        if parts.is_absolute() or ".." in parts.parts or (len(name) > 1 and name[1] == ":"):
            raise UnsafeArchive(f"path leaves the archive: {name}")
        if e.file_size > max_file:
            raise UnsafeArchive(f"file too large: {name}")
        if e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise UnsafeArchive(f"encrypted or of an unknown method: {name}")
        total += e.file_size
        if total > max_total:
            raise UnsafeArchive("archive too large")
    return entries


def top_directory(names: list[str]) -> str:
    """The one directory that holds everything ('' if there is none)."""
    tops = {n.split("/", 1)[0] for n in names if "/" in n}
    return tops.pop() if len(tops) == 1 and all("/" in n for n in names) else ""


@dataclass(frozen=True)
class Wanted:
    """Which files are wanted; empty fields want all."""

    prefix: str = ""
    suffixes: tuple[str, ...] = ()
    names: tuple[str, ...] = ()

    @staticmethod
    def of(options: dict) -> Wanted:
        parts = (tuple(x.strip() for x in options.get(n, "").split(",") if x.strip()) for n in ("suffixes", "names"))
        return Wanted(options.get("prefix", ""), *parts)

    def file(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return path.startswith(self.prefix) and (not self.suffixes or name.endswith(self.suffixes)) and (not self.names or name in self.names)

    def below(self, directory: str) -> bool:
        """Whether a directory ('' or with a slash at its end) may hold wanted files."""
        return self.prefix.startswith(directory) or directory.startswith(self.prefix)


def listed(root: str, directory: str) -> tuple[list[str], list[str]]:
    """(files, directories) right below a directory, relative to root; links to directories are not followed."""
    files, below = [], []
    try:
        with os.scandir(os.path.join(root, directory)) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    below.append(f"{directory}{e.name}/")
                elif e.is_file():
                    files.append(f"{directory}{e.name}")
    except OSError:
        pass  # gone meanwhile, or closed to us
    return sorted(files), sorted(below)


def walked(root: str, directory: str, wanted: Wanted) -> Iterator[str]:
    """The wanted files below a directory."""
    todo = [directory]
    while todo:
        at = todo.pop()
        if wanted.below(at):
            files, below = listed(root, at)
            yield from filter(wanted.file, files)
            todo += reversed(below)


class _Directory(InputPartition):
    def __init__(self, directory: str, whole: bool):
        self.directory, self.whole = directory, whole  # whole: with all that is below


class _Entries(InputPartition):
    """Entries of an archive: (path, mode, place of the header, compressed size, size, method, crc32)."""

    def __init__(self, entries: list[tuple]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict, content: bool):
        self.path = options["path"]
        self.subdir = options.get("subdir", "").strip("/")
        self.has_content = content
        self.content = content and options.get("content", "true").lower() != "false"
        self.limits = [int(options.get(k, options.get(k.lower(), v))) for k, v in LIMITS.items()]
        self.given = options.get("directories")
        self.wanted = Wanted.of(options)

    @property
    def root(self) -> str:
        return tree_root(self.path, self.subdir)

    def partitions(self) -> list[InputPartition]:
        if self.path.endswith(".zip"):
            return self._archive_parts()
        if self.given is not None:
            parts = [_Directory(d, whole) for d, whole in json.loads(self.given)]
        else:
            parts = [_Directory("", False), *(_Directory(d, True) for d in listed(self.root, "")[1])]
        return [p for p in parts if self.wanted.below(p.directory)] or [_Entries([])]

    def _archive_parts(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            entries = checked_entries(z, *self.limits)
        top = top_directory([e.filename for e in entries])
        parts, size = [_Entries([])], 0
        for e in sorted(entries, key=lambda e: e.header_offset):
            path = e.filename[len(top) + 1 :] if top else e.filename
            if self.subdir:
                path = path[len(self.subdir) + 1 :] if path.startswith(self.subdir + "/") else ""
            if path and self.wanted.file(path):
                if size > ARCHIVE_BYTES:
                    parts.append(_Entries([]))
                    size = 0
                parts[-1].entries.append((path, (e.external_attr >> 16) & 0o7777, e.header_offset, e.compress_size, e.file_size, e.compress_type, e.CRC))
                size += e.compress_size
        return parts

    def _row(self, path: str, mode: int, data: bytes | None) -> tuple:
        return (path, mode, data) if self.has_content else (path, mode)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Entries):
            yield from self._inflated(partition.entries)
            return
        root = self.root
        paths = walked(root, partition.directory, self.wanted) if partition.whole else filter(self.wanted.file, listed(root, partition.directory)[0])
        for path in paths:
            full = os.path.join(root, path)
            try:
                mode = os.stat(full).st_mode & 0o7777
                data = read_file(full) if self.content else None
            except OSError:
                continue
            yield self._row(path, mode, data)

    def _inflated(self, entries: list[tuple]) -> Iterator[tuple]:
        if not entries:
            return
        with open(self.path, "rb") as f:
            for path, mode, place, packed, size, method, crc in entries:
                data = None
                if self.content:
                    f.seek(place)
                    header = f.read(30)
                    f.seek(place + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
                    raw = f.read(packed)
                    inflater = zlib.decompressobj(-15)
                    # no more than the directory says, whatever the bytes would give
                    data = raw if method == zipfile.ZIP_STORED else inflater.decompress(raw, size + 1)
                    if header[:4] != b"PK\x03\x04" or len(data) != size or zlib.crc32(data) != crc:
                        raise UnsafeArchive(f"damaged entry: {path}")
                yield self._row(path, mode, data)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), "content" in schema.names)


def tree_root(path: str, subdir: str = "") -> str:
    root = os.path.join(path, subdir) if subdir else path
    if os.path.commonpath([os.path.realpath(root), os.path.realpath(path)]) != os.path.realpath(path):
        raise ValueError("subdir leaves the target")
    return root


def directories(spark: SparkSession, root: str, enough: int, most: int = MAX_DIRECTORIES) -> list[tuple[str, bool]]:
    """(directory, whether with all below it) that together hold every file once.

    Level by level a job lists directories, until there are ``enough`` or a level has more than
    ``most``; the driver lists the top level alone.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([d for at in b.column(0).to_pylist() for d in listed(root, at)[1]], pa.string())], ["d"])

    done, level = [("", False)], listed(root, "")[1]
    while level and len(done) + len(level) < enough:
        parts = min(len(level), spark.sparkContext.defaultParallelism)
        found = spark.createDataFrame([(d,) for d in level], "d string").repartition(parts).mapInArrow(expand, "d string").limit(most + 1).collect()
        if len(found) > most or not found:
            break
        done += [(d, False) for d in level]
        level = sorted(r["d"] for r in found)
    return done + [(d, True) for d in level]


def read_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The files of a directory or an archive; a directory is dealt out to a few tasks for each core."""
    spark.dataSource.register(SourceTree)
    if not path.endswith(".zip") and "directories" not in options:
        root = tree_root(path, str(options.get("subdir", "")).strip("/"))
        options["directories"] = json.dumps(directories(spark, root, 4 * spark.sparkContext.defaultParallelism))
    return spark.read.format("sourcetree").options(**{k: str(v) for k, v in options.items()}).load(path)

"""Project trees and archives as a data source: `spark.read.format("trees").load(root)`.

Every folder below the root is a project, and so is every zip archive. Planning lists names only: a project is cut into one
partition for each folder down to `depth`, an archive into one for each `range` bytes of it. Tasks list, open and decode;
no content passes the driver. Names that begin with a dot or an underscore are files like any other (Spark's own file
sources pass over them). Links are not followed, and what a project never counts as its own (`ALWAYS_IGNORED`) is not entered.

Columns: project_id, path (relative, with /), size in bytes, content (UTF-8, what is no UTF-8 replaced) and skipped: why content is
null. Rows of files over `maxRead` bytes, of unreadable or encrypted ones and of archives that are none, or that hold an entry
which would leave their folder (one row, path null), say so there. An archive's repeated name counts as its last entry.

Options: single (the path itself is the one project), project (its name), depth (2), range (64 MiB), maxRead (15 MiB).
Paths are folders that all executors see, or addresses that pyarrow's file systems read (hdfs://, s3://).
"""

from __future__ import annotations

import os
import posixpath
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are never scanned, and the largest file that is read.
ALWAYS_IGNORED = ["node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "venv", ".cache", "coverage", ".nyc_output", ".turbo"]
MAX_READ = 15 * 1024 * 1024
RANGE = 64 * 1024 * 1024
#: Bytes of content in a batch of rows.
BATCH = 16 * 1024 * 1024

SCHEMA = "project_id string, path string, size long, content string, skipped string"
_ARROW = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.string()), ("skipped", pa.string())])


class _Local:
    def list(self, at: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, size) in order of names; links and what is neither file nor folder are left out."""
        out = []
        with os.scandir(at) as entries:
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        out.append((e.name, True, 0))
                    elif e.is_file(follow_symlinks=False):
                        out.append((e.name, False, e.stat(follow_symlinks=False).st_size))
                except OSError:
                    continue
        return sorted(out)

    def open(self, at: str):
        return open(at, "rb")


class _Remote:
    def __init__(self, fs):
        self.fs = fs

    def list(self, at: str) -> list[tuple[str, bool, int]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(at))
        return sorted((i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in found if i.type in (fs.FileType.Directory, fs.FileType.File))

    def open(self, at: str):
        return self.fs.open_input_file(at)


def _store(path: str):
    """What reads the path, and the path as it names it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return _Local(), os.path.abspath(path)
    from pyarrow import fs

    found, inner = fs.FileSystem.from_uri(path)
    return _Remote(found), inner


@dataclass
class Folder(InputPartition):
    """Files of one folder, or of all below it."""

    project: str
    root: str
    below: str
    deep: bool


@dataclass
class ArchiveRange(InputPartition):
    """Entries of an archive whose header begins in [first, end)."""

    project: str
    at: str
    first: int
    end: int


def _own(name: str) -> bool:
    return name not in ALWAYS_IGNORED


class TreesReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError("load needs a path")
        self.path = options["path"]
        self.single = str(options.get("single", "false")).lower() == "true"
        self.project = options.get("project")
        self.depth, self.range, self.max_read = int(options.get("depth", 2)), int(options.get("range", RANGE)), int(options.get("maxread", MAX_READ))

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        if self.single:
            name = self.project or posixpath.basename(root.rstrip("/"))
            if root.endswith(".zip"):
                with store.open(root) as f:
                    size = f.seek(0, 2)
                return self._ranges(self.project or name[:-4], root, size or f.tell())
            return list(self._folders(store, name, root, "", self.depth))
        out: list[InputPartition] = []
        for name, is_dir, size in store.list(root):
            if is_dir:
                out += self._folders(store, name, f"{root}/{name}", "", self.depth)
            elif name.lower().endswith(".zip"):
                out += self._ranges(name[:-4], f"{root}/{name}", size)
        return out

    def _folders(self, store, project: str, root: str, below: str, depth: int) -> Iterator[InputPartition]:
        if depth <= 0:
            yield Folder(project, root, below, True)
            return
        yield Folder(project, root, below, False)
        try:
            inner = [n for n, is_dir, _ in store.list(f"{root}/{below}".rstrip("/")) if is_dir and _own(n)]
        except OSError:
            return
        for n in inner:
            yield from self._folders(store, project, root, posixpath.join(below, n), depth - 1)

    def _ranges(self, project: str, at: str, size: int) -> list[InputPartition]:
        return [ArchiveRange(project, at, a, a + self.range) for a in range(0, max(1, size), self.range)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, held = [], 0
        for path, size, content, skipped in self._folder(store, partition) if isinstance(partition, Folder) else self._archive(store, partition):
            rows.append((partition.project, path, size, content, skipped))
            held += len(content or "")
            if held >= BATCH or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _folder(self, store, part: Folder) -> Iterator[tuple]:
        waiting = [part.below]
        while waiting:
            below = waiting.pop()
            try:
                entries = store.list(f"{part.root}/{below}".rstrip("/"))
            except OSError:  # a folder that cannot be read does not end the scan
                continue
            for name, is_dir, size in entries:
                path = posixpath.join(below, name)
                if not _own(name):
                    continue
                if is_dir:
                    if part.deep:
                        waiting.append(path)
                    continue
                if size > self.max_read:
                    yield path, size, None, "too large"
                    continue
                try:
                    with store.open(f"{part.root}/{path}") as f:
                        yield path, size, f.read().decode("utf-8", "replace"), None
                except OSError:
                    yield path, size, None, "unreadable"

    def _archive(self, store, part: ArchiveRange) -> Iterator[tuple]:
        try:
            with store.open(part.at) as f, zipfile.ZipFile(f) as z:
                last = {e.filename: e for e in z.infolist() if not e.is_dir()}
                bad = next((n for n in last if _leaves(n)), None)
                if bad is not None:
                    if part.first == 0:
                        yield None, None, None, f"unsafe entry path: {bad}"
                    return
                for name, e in last.items():
                    path = posixpath.normpath(name)
                    if not part.first <= e.header_offset < part.end or not all(map(_own, path.split("/"))) or stat.S_ISLNK(e.external_attr >> 16):
                        continue
                    yield path, e.file_size, *self._entry(z, e)
        except (OSError, zipfile.BadZipFile, NotImplementedError) as why:
            if part.first == 0:
                yield None, None, None, f"no archive: {type(why).__name__}"

    def _entry(self, z: zipfile.ZipFile, e: zipfile.ZipInfo) -> tuple[str | None, str | None]:
        if e.file_size > self.max_read:
            return None, "too large"
        if e.flag_bits & 1:
            return None, "encrypted"
        try:
            with z.open(e) as f:  # the size that an archive states need not be true
                data = f.read(self.max_read + 1)
        except Exception:
            return None, "unreadable"
        return (None, "too large") if len(data) > self.max_read else (data.decode("utf-8", "replace"), None)


def _leaves(name: str) -> bool:
    name = name.replace("\\", "/")
    return name.startswith("/") or posixpath.normpath(name).split("/")[0] == ".."


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class Trees(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreesReader:
        return TreesReader(dict(self.options))


def read_trees(spark: SparkSession, root: str, **options) -> DataFrame:
    """The columns of SCHEMA for all projects below root."""
    spark.dataSource.register(Trees)
    return spark.read.format("trees").options(**options).load(root)

"""File inventories as a Spark data source, read in a batch or followed as a stream under one name.

``spark.read.format("inventory").load(root)`` lists every file under a folder: path, size and mtime, names that begin with
a dot or an underscore too. ``spark.readStream.format("inventory").load(root)`` gives what was written since the last offset.

Folders are the partitions. Planning opens levels of folders, widest first, until there are ``tasks`` of them (64; a
level is opened whole) or no more levels, and lists no file; each task lists its folder and all below it, one folder at a
time, so a task holds the names of one folder. Roots are local paths or the addresses that ``pyarrow.fs`` knows (``file:``,
``hdfs:``, ``s3:``, ``gs:``), the same for driver and executors.

Options: ``recursive`` (true), ``tasks``, and of streams ``settle`` (10: seconds after which a file's time counts as
settled, so that clocks may differ) and ``whole`` (false; true gives every file in every batch, which a merge with
``scanned`` roots needs to see what is gone).

An offset is a time: a batch holds the files changed after the last one and up to it, so files are given once for each
change, and a batch repeated after a failure differs only by files that have changed again, which come in a later one. A
stream of changes does not show what was removed or what was moved in with an older time; a ``whole`` one does.

Symbolic links look like what they point at; a local folder that leads back to one above it is not entered twice.
Folders that are gone when their turn comes hold no file; a root that is no folder is an error. No file: no rows.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Before the time of any file.
NEVER = -(1 << 62)
_SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
_ROWS = 10_000


@dataclass
class Folder(InputPartition):
    """A folder, with those below it or alone, and the times (after, up to) of the files that count."""

    path: str
    deep: bool
    after: int = NEVER
    until: int = -NEVER


def _opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a root, the root's path in it, and what stands before such paths in an address."""
    if "://" not in root:  # file:/a is what Spark writes
        return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")), "file:"
    files, path = fs.FileSystem.from_uri(root)
    path = path.rstrip("/") or "/"
    before = root.rstrip("/").removesuffix(path)
    return files, path, "file:" if root.startswith("file:") else before


class _Listing:
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.tasks = int(options.get("tasks", 64))

    def folders(self) -> list[Folder]:
        """What a task lists, each: folders that were opened alone, the others with all below them."""
        files, root, _ = _opened(self.root)
        if files.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder: {self.root}")
        if not self.recursive:
            return [Folder(root, False)]
        alone: list[str] = []
        level = [root]
        while level and len(level) < self.tasks:
            alone += level
            level = [x.path for folder in level for x in _children(files, folder) if x.type == fs.FileType.Directory]
        return [*(Folder(x, False) for x in alone), *(Folder(x, True) for x in level)]

    def rows(self, part: Folder) -> Iterator[pa.RecordBatch]:
        files, _, before = _opened(self.root)
        todo = [part.path]
        while todo:
            folder = todo.pop()
            found: list[fs.FileInfo] = []
            for x in _children(files, folder):
                if x.type == fs.FileType.Directory:
                    if part.deep:
                        todo.append(x.path)
                elif part.after < x.mtime_ns // 1000 <= part.until:
                    found.append(x)
            for i in range(0, len(found), _ROWS):
                some = found[i : i + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([before + x.path for x in some]), pa.array([x.size for x in some], pa.int64()), pa.array([x.mtime_ns // 1000 for x in some], pa.timestamp("us", "UTC"))], schema=_SCHEMA)


def _children(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder itself holds, but for folders that lead back to one above and for what is neither file nor folder."""
    found = [x for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type in (fs.FileType.File, fs.FileType.Directory)]
    if not isinstance(files, fs.LocalFileSystem):
        return found
    above = f"{os.path.realpath(folder)}/"
    return [x for x in found if x.type == fs.FileType.File or not os.path.islink(x.path) or not above.startswith(f"{os.path.realpath(x.path).rstrip('/')}/")]


class _Batch(_Listing, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.folders()

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _Changes(_Listing, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.settle = float(options.get("settle", 10))
        self.whole = options.get("whole", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"until": NEVER}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000 - int(self.settle * 1_000_000)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        if not self.whole:
            return [Folder(x.path, x.deep, start["until"], end["until"]) for x in self.folders()]
        return self.folders()

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class Inventory(DataSource):
    """The source that ``spark.dataSource.register(Inventory)`` makes known as ``inventory``."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(dict(self.options))


def inventory(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, size and mtime of the files under ``root``; options as above."""
    spark.dataSource.register(Inventory)
    return spark.read.format("inventory").options(**options).load(root)


def watch(spark: SparkSession, root: str, **options) -> DataFrame:
    """A stream of the files under ``root`` that are new or changed; options as above."""
    spark.dataSource.register(Inventory)
    return spark.readStream.format("inventory").options(**options).load(root)

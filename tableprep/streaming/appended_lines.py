"""Lines appended to log files, as a stream: how far each file was read is kept in bytes.

Spark's own file stream sees new files only. This source looks at the sizes of the files of a folder, and a batch is
what was appended since the last one, up to the last line break. The offsets of a batch are one number for each file.
Files grow at their end only; one that became shorter is an error, as what was read of it is no longer there.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "appended_lines"
# Bytes of one file that a task reads, and that are looked at together in search of a line break.
TASK_BYTES = 64 << 20
BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Bytes of one file: the lines that begin in [begin, stop)."""

    path: str
    begin: int
    stop: int


class AppendedLines(DataSource):
    """Options: path (a folder, or a URI that Arrow's file systems know), files (a pattern of file names)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_path string, begin bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return AppendedLinesReader(self.options)


class AppendedLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        # option names come in lower case whatever their spelling
        self.path, self.files = options["path"], options.get("files", "*")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.ends: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def _place(self) -> tuple[fs.FileSystem, str]:
        plain = self.path.removeprefix("file:")
        if "://" in plain:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Per file the place after its last line break. Only files that grew since the last look are opened."""
        system, root = self._place()
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            name = info.path.rpartition("/")[2]
            if info.type != fs.FileType.File or not fnmatch.fnmatch(name, self.files) or name.startswith((".", "_")):
                continue
            if info.size < self.sizes.get(info.path, 0):
                raise ValueError(f"{info.path} became shorter: it is not appended to")
            if info.size > self.sizes.get(info.path, 0):
                self.ends[info.path] = _after_last_break(system, info.path, info.size, self.ends.get(info.path, 0))
                self.sizes[info.path] = info.size
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            if stop < first:
                raise ValueError(f"{path} became shorter: it is not appended to")
            # every stretch but a batch's first begins somewhere in a line, which belongs to the one before
            found += [Stretch(path, at, min(at + self.task_bytes, stop)) for at in range(first, stop, self.task_bytes)]
        return found

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        system, _ = self._place()
        with system.open_input_file(partition.path) as file:
            at = partition.begin
            if at:
                # a line begins after a break: at `begin` itself if the byte before it is one
                file.seek(at - 1)
                at = at - 1 + len(_to_break(file))
            file.seek(at)
            while at < partition.stop:
                line = _to_break(file)
                if not line:
                    break
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)
                file.seek(at)

    def commit(self, end: dict) -> None:
        """Nothing is kept but the offsets, which Spark writes down."""


def _to_break(file) -> bytes:
    """The bytes up to the next line break, that included."""
    found = []
    while block := file.read(BLOCK):
        place = block.find(b"\n")
        if place >= 0:
            found.append(block[: place + 1])
            break
        found.append(block)
    return b"".join(found)


def _after_last_break(system: fs.FileSystem, path: str, size: int, known: int) -> int:
    """The place after the last line break of the first `size` bytes, at least `known`; read from the end backwards."""
    with system.open_input_file(path) as file:
        stop = size
        while stop > known:
            first = max(known, stop - BLOCK)
            file.seek(first)
            place = file.read(stop - first).rfind(b"\n")
            if place >= 0:
                return first + place + 1
            stop = first
    return known


def read_appended_lines(spark: SparkSession, path: str, *, files: str = "*", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file_path, begin, value) of every line of the folder's files as it is appended; blank lines too."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format(FORMAT).option("path", path).option("files", files).option("taskBytes", str(task_bytes)).load()

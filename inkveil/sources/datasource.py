"""A data source for documents: `spark.read.format("inkveil_documents").load(folder)` gives the units of all files of known formats, and a frame of paths and
contents is written as files by the executors.

Reading: the driver lists names and sizes only; files are dealt out over partitions by size, and each is opened where it is read. Writing is in two phases: tasks write into a
hidden folder, and only when all have ended are the files moved to their names; a job that fails leaves nothing, and a repeated task's files are
those of its last attempt. Folders are of any file system that pyarrow knows (plain paths are local).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import formats

NAME = "inkveil_documents"
#: Bytes of files in a partition, unless one is larger.
PARTITION_BYTES = 32 << 20
UNITS, FILES = "path string, n int, text string", "path string, content binary"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _known(name: str) -> bool:
    return posixpath.splitext(name)[1].lower() in formats.FORMATS


@dataclass
class Files(InputPartition):
    paths: list[str]


class UnitReader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most = root, most

    def partitions(self) -> list[InputPartition]:
        """Files in order of their paths, so many bytes together."""
        from pyarrow import fs

        files, root = _filesystem(self.root)
        there = files.get_file_info(root)
        if there.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        every = [there] if there.is_file else [x for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/"))]
        out: list[InputPartition] = []
        held, size = [], 0
        for info in sorted((x for x in every if _known(x.path)), key=lambda x: x.path):
            if held and size + info.size > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _filesystem(self.root)
        for path in partition.paths:
            with files.open_input_stream(path) as file:
                texts = formats.units(posixpath.splitext(path)[1].lower(), file.read())
            yield from ((path, n, text) for n, text in enumerate(texts))


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its files, and their names in the end."""

    moves: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Of rows of path (in the folder that is written to) and content."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.hidden = f"_writing-{uuid.uuid4().hex}"
        # made here alone, so that a task that is still running when the job was given up can't make it again
        files, folder = _filesystem(self.root)
        files.create_dir(f"{folder}/{self.hidden}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        files, root = _filesystem(self.root)
        own, moves = f"{root}/{self.hidden}/{uuid.uuid4().hex}", []
        files.create_dir(own, recursive=False)
        for n, row in enumerate(rows):
            target = posixpath.normpath(row.path)
            if posixpath.isabs(target) or target.split("/")[0] in ("..", "."):
                raise ValueError(f"{row.path} is not in the folder")
            with files.open_output_stream(f"{own}/{n}") as file:
                file.write(bytes(row.content or b""))
            moves.append((f"{own}/{n}", target))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _filesystem(self.root)
        moves = [m for message in messages if message for m in message.moves]
        targets = [t for _, t in moves]
        try:
            if twice := {t for t in targets if targets.count(t) > 1} if len(set(targets)) < len(targets) else set():
                raise ValueError(f"written twice: {sorted(twice)[:3]}")
            there = [x.path for x in files.get_file_info([f"{root}/{t}" for t in targets]) if x.type != fs.FileType.NotFound]
            if there and not self.overwrite:
                raise FileExistsError(f"there already: {there[:3]}")
            for source, target in moves:
                files.create_dir(posixpath.dirname(f"{root}/{target}"), recursive=True)
                files.move(source, f"{root}/{target}")
        finally:
            self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        files, root = _filesystem(self.root)
        for last in (False, False, True):  # a task may put a file into it just now
            try:
                if files.get_file_info(f"{root}/{self.hidden}").type != fs.FileType.NotFound:
                    files.delete_dir(f"{root}/{self.hidden}")
                return
            except OSError:
                if last:
                    raise


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return UNITS

    def reader(self, schema: StructType) -> DataSourceReader:
        return UnitReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError(f"to be written: {FILES}")
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)

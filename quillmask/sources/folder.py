"""Data sources over folders: pages of files, in a table or as a stream, and files that appear all together or not at all.

    spark.dataSource.register(PageFiles)
    spark.read.format("page_files").option("path", folder).option("reader", "my.module:pages").load()
    spark.dataSource.register(FileSet)
    rows.write.format("file_set").mode("append").option("path", folder).option("name", "run-7").save()

Only names and sizes are listed by the driver; executors open the files. Folders are those that pyarrow's file systems know.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .documents import PAGES

#: Bytes of files that one task reads, unless one file is larger.
BYTES = 64 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_FIELDS = [(c.split()[0], _ARROW[c.split()[1]]) for c in PAGES.split(", ")]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    found, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return found, root.rstrip("/")


def text_pages(path: str, content: bytes) -> Iterator[dict]:
    """Pages of a text file, parted by form feeds."""
    for i, text in enumerate(content.decode(errors="replace").split("\f")):
        yield {"page_num": i + 1, "text": text, "method": "native", "confidence": 1.0}


def _reader(options: dict) -> Callable[[str, bytes], Iterator[dict]]:
    module, _, name = options.get("reader", f"{__name__}:text_pages").partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def planned(found: list[tuple[str, int]], most: int) -> list[Files]:
    """Files (path, bytes) dealt to tasks, largest first, each to the one that has least, so that none has much more than most bytes."""
    n = max(1, min(len(found), -(-sum(size for _, size in found) // most)))
    tasks: list[list[str]] = [[] for _ in range(n)]
    load = [0] * n
    for path, size in sorted(found, key=lambda f: (-f[1], f[0])):
        i = load.index(min(load))
        tasks[i].append(path)
        load[i] += size
    return [Files(tuple(t)) for t in tasks if t]


class _Pages:
    def __init__(self, options: dict):
        self.options = options
        self.columns = [c for c in options.get("columns", "").split(",") if c] or [n for n, _ in _FIELDS]

    def _listed(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes) of the folder's files, hidden ones and folders left out."""
        files, root = _place(self.options["path"])
        there = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in there if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A batch a page, so that the pages of a large file are never held together. A file that cannot be read is a page 0 with the reason."""
        reader, (files, _) = _reader(self.options), _place(self.options["path"])
        schema = pa.schema([f for f in _FIELDS if f[0] in self.columns])
        for path in partition.paths:
            try:
                with files.open_input_file(path) as f:
                    content = f.read()
                for page in reader(path, content):
                    yield pa.RecordBatch.from_pylist([{n: (path if n == "doc_id" else page.get(n)) for n in schema.names}], schema=schema)
            except Exception as e:  # noqa: BLE001  the reason belongs in the table, and other files go on
                row = {"doc_id": path, "page_num": 0, "text": None, "method": f"failed: {e}"}
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in schema.names}], schema=schema)


class _PagesTable(_Pages, DataSourceReader):
    def partitions(self) -> list[Files]:
        return planned([(p, size) for _, p, size in self._listed()], int(self.options.get("bytes", BYTES))) or [Files(())]


class _PagesStream(_Pages, DataSourceStreamReader):
    """Offsets are the time and path of the last file of a batch. Files must come by a move (or be whole when they appear), none with an
    earlier time than one that was read."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self._listed()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return planned([(p, size) for t, p, size in self._listed() if low < (t, p) <= high], int(self.options.get("bytes", BYTES))) or [Files(())]

    def commit(self, end: dict) -> None:
        pass


class PageFiles(DataSource):
    """Pages of the files of a folder: options path, reader (module:function that yields the pages of a file's name and content as
    dictionaries; by default text with form feeds), columns (those to make, by default all of PAGES) and bytes (of files for a task)."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return ", ".join(c for c in PAGES.split(", ") if not wanted or c.split()[0] in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagesTable(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _PagesStream(dict(self.options))


@dataclass
class Wrote(WriterCommitMessage):
    paths: tuple[str, ...]


class _FileSetWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.name, self.overwrite = options["path"], options["name"], overwrite
        if "/" in self.name or self.name.startswith("."):
            raise ValueError("the set's name must be one of a folder")
        self.staging = f".{self.name}-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Wrote:
        files, root = _place(self.path)
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # another one when the task runs again
        files.create_dir(own)
        made = []
        for row in rows:
            if row["name"] in ("", ".", "..") or "/" in row["name"]:
                raise ValueError(f"{row['name']!r} is no name of a file")
            with files.open_output_stream(f"{own}/{row['name']}") as out:
                out.write(bytes(row["data"]))
            made.append(f"{own}/{row['name']}")
        return Wrote(tuple(made))

    def commit(self, messages: list[Wrote | None]) -> None:
        """Puts the files that count in one folder, and that in its place by one move."""
        files, root = _place(self.path)
        paths = [p for m in messages if m is not None for p in m.paths]
        names = [p.rpartition("/")[2] for p in paths]
        target, out = f"{root}/{self.name}", f"{root}/{self.staging}/out"
        there = files.get_file_info(target).type != fs.FileType.NotFound
        if len(set(names)) < len(names) or there and not self.overwrite:
            self.abort(messages)
            raise ValueError("two files have one name" if not there else f"{self.name} is there already")
        files.create_dir(out)
        for path, name in zip(paths, names, strict=True):
            files.move(path, f"{out}/{name}")
        if there:
            files.delete_dir(target)
        files.move(out, target)
        files.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Wrote | None]) -> None:
        files, root = _place(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class FileSet(DataSource):
    """A set of files, one for each row (name string, data binary), in a folder of their own: options path and name. They appear together when all
    have been written; a job that fails leaves none. A set that is there already is an error, or with the mode overwrite replaced."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileSetWriter(dict(self.options), overwrite)

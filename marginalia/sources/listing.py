"""A Spark data source that lists and reads the files below a folder, hidden names too, with folders dealt out to tasks.

    spark.dataSource.register(FolderSource)
    spark.read.format("note_files").option("content", "true").load("/notes")

Spark's own file sources leave out names that begin with a dot or an underscore. The driver lists folders level by level until there are FOLDERS of
them; each task then walks the folders that it is given. The folder must be one that driver and executors see (a disk they share). Files that
vanish or cannot be read while they are listed are left out; a file whose content cannot be read has the reason in `error`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FOLDERS, TASKS = 512, 64
SCHEMA = "rel_path string, abs_path string, mtime double, size bigint, content binary, error string"


class Folders(InputPartition):
    """Folders to walk wholly (deep), and folders whose own files alone are wanted (flat)."""

    def __init__(self, deep: list[str], flat: list[str]):
        super().__init__(None)
        self.deep, self.flat = deep, flat


def _entries(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            yield from sorted(found, key=lambda e: e.name)
    except OSError:
        return


class FolderReader(DataSourceReader):
    def __init__(self, root: str, content: bool, extensions: tuple[str, ...]):
        self.root, self.content, self.extensions = os.path.abspath(root), content, extensions

    def partitions(self) -> list[Folders]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        level, flat = [self.root], []
        while level and len(level) < FOLDERS:
            below = [e.path for folder in level for e in _entries(folder) if e.is_dir(follow_symlinks=False)]
            flat += level
            level = below
        tasks = max(1, min(TASKS, len(level) + len(flat)))
        return [Folders(level[i::tasks], flat[i::tasks]) for i in range(tasks)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.flat:
            yield from self._files(folder)
        for top in partition.deep:
            waiting = [top]
            while waiting:
                folder = waiting.pop()
                waiting += [e.path for e in _entries(folder) if e.is_dir(follow_symlinks=False)]
                yield from self._files(folder)

    def _files(self, folder: str) -> Iterator[tuple]:
        for e in _entries(folder):
            if self.extensions and os.path.splitext(e.name)[1].lower() not in self.extensions:
                continue
            try:
                if not e.is_file():
                    continue
                state = e.stat()
            except OSError:
                continue
            data, error = None, None
            if self.content:
                try:
                    with open(e.path, "rb") as f:
                        data = f.read()
                except OSError as x:
                    error = f"{type(x).__name__}: {x.strerror}"
            yield os.path.relpath(e.path, self.root).replace(os.sep, "/"), e.path, state.st_mtime, state.st_size, data, error


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        some = tuple(x for x in self.options.get("extensions", "").lower().split(",") if x)
        return FolderReader(self.options["path"], self.options.get("content", "false").lower() == "true", some)

"""The ``vault`` data source: the notes of a folder, as ``spark.read.format("vault")``.

Options: path; dialect (``prose``: every folder except hidden ones and ``trash``; ``outline``: only ``pages`` and
``journals``). Built-in file sources hide names that begin with ``_`` or ``.``, which
are notes here.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "rel_path string, mtime bigint, content string, error string"
#: Folders of an outline, and the folder that a prose vault keeps its deleted notes in.
OUTLINE_FOLDERS, TRASH = ("pages", "journals"), "trash"


def folders(folder: str, dialect: str) -> list[str]:
    """Folders right below one that belong to the vault, without links."""
    found = sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)) if os.path.isdir(folder) else []
    return [f for f in found if dialect == "outline" or not os.path.basename(f).startswith(".") and os.path.basename(f) != TRASH]


def walk(top: str, root: str, dialect: str, deep: bool = True) -> Iterator[str]:
    """Paths, relative to ``root``, of the notes in the folder ``top`` and, if ``deep``, below it: regular files named ``*.md``, without links."""
    if os.path.isdir(top):
        for entry in sorted(os.scandir(top), key=lambda e: e.name):
            if entry.name.endswith(".md") and entry.name != ".md" and entry.is_file(follow_symlinks=False):
                yield os.path.relpath(entry.path, root).replace(os.sep, "/")
    for below in folders(top, dialect) if deep else ():
        yield from walk(below, root, dialect)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.dialect = options.get("path", ""), options.get("dialect", "prose")
        if self.dialect not in ("prose", "outline"):
            raise ValueError("dialect must be prose or outline")

    def partitions(self) -> list[InputPartition]:
        """Two levels of folders only; the tasks list and read what is in and below them. The folder is one that all executors see."""
        tops = [os.path.join(self.root, d) for d in OUTLINE_FOLDERS] if self.dialect == "outline" else [self.root]
        middle = [f for top in tops for f in folders(top, self.dialect)]
        return [*(Folder(f, False) for f in tops + middle), *(Folder(f, True) for m in middle for f in folders(m, self.dialect))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        """A row for each note; one that can't be read has an error and no content."""
        for path in walk(partition.path, self.root, self.dialect, partition.deep):
            full = os.path.join(self.root, path)
            try:
                mtime = int(os.stat(full).st_mtime)
                with open(full, "rb") as file:
                    yield path, mtime, file.read().decode("utf-8"), None
            except (OSError, UnicodeDecodeError) as problem:
                yield path, None, None, str(problem)


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return VaultReader(self.options)


def write(notes: DataFrame, root: str) -> None:
    """Each of ``notes`` (rel_path, content) as a file below ``root``, a folder that all executors see; rows without either are left out."""

    def files(rows: Iterator[Row]) -> None:
        for row in rows:
            path = os.path.join(root, row["rel_path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as file:
                file.write(row["content"].encode("utf-8"))

    os.makedirs(root, exist_ok=True)
    notes.filter("rel_path is not null and content is not null").select("rel_path", "content").foreachPartition(files)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)

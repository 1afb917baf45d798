"""File inventories: from a directory tree, or from any table with a path column.

The directory source lists leaves of a tree, hidden ones too, and doesn't follow links to directories (such a link is a leaf). A tree is divided into ``SUBTREES``
parts at most, whatever its shape; a directory with very many entries is divided by its entries' names. ``columns`` says what is read of a file, so a listing never opens
one. Conditions on the path's beginning or value, and on is_file, are met inside the source: subtrees that can't match are never listed.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from filewright.functions.names import decomposed

SCHEMA = "path string, length long, is_file boolean"
#: Parts that a scan is divided into at most; entries of a directory that the driver looks at to divide it.
SUBTREES, LOOKED_AT = 64, 10_000


class Unit:
    """A directory: its own files or, if deep, all below it; of its entries, those whose name's number modulo ``of`` is ``share``."""

    def __init__(self, path: str, deep: bool, share: int = 0, of: int = 1):
        self.path, self.deep, self.share, self.of = path, deep, share, of

    def has(self, name: str) -> bool:
        return self.of == 1 or zlib.crc32(os.fsencode(name)) % self.of == self.share


class Part(InputPartition):
    def __init__(self, units: list[Unit]):
        self.units = units


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.content = options.get("columns", "listing") == "content"
        #: beginnings, one of which a path must have, for each condition met here; and whether only files, or only others, are asked for
        self.beginnings: list[list[str]] = []
        self.is_file: bool | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.beginnings.append([f.value])
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                self.beginnings.append(list(f.value) if isinstance(f, In) else [f.value])
                yield f  # the value itself is compared by Spark
            elif isinstance(f, EqualTo) and f.attribute == ("is_file",):
                self.is_file = bool(f.value)
            else:
                yield f

    def _may_hold(self, directory: str) -> bool:
        """Whether paths below a directory can have the beginnings that are asked for."""
        below = directory.rstrip("/") + "/"
        return all(any(below.startswith(x) or x.startswith(below) for x in some) for some in self.beginnings)

    def _sub_directories(self, directory: str) -> list[str] | None:
        """None if the directory has too many entries to look at."""
        with os.scandir(directory) as entries:
            some = list(islice(entries, LOOKED_AT + 1))
        return None if len(some) > LOOKED_AT else sorted(e.path for e in some if e.is_dir(follow_symlinks=False) and self._may_hold(e.path))

    def partitions(self) -> list[Part]:
        """Directories are divided into their own files and their sub-directories until there are enough; then units are dealt out."""
        done, below, looked_at = [], [self.root] if self._may_hold(self.root) else [], 0
        while below and looked_at + len(below) < SUBTREES:
            directory = below.pop(0)
            looked_at += 1
            deeper = self._sub_directories(directory)
            if deeper is None:
                done += [Unit(directory, True, k, SUBTREES) for k in range(SUBTREES)]
            else:
                done.append(Unit(directory, False))
                below += deeper
        units = sorted(done, key=lambda u: u.of) + [Unit(d, True) for d in below]
        return [Part(units[k::SUBTREES]) for k in range(min(SUBTREES, len(units)))] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for unit in partition.units:
            yield from self._rows(unit)

    def _rows(self, unit: Unit) -> Iterator[tuple]:
        stack = [unit.path]
        while stack:
            directory = stack.pop()
            with os.scandir(directory) as entries:
                for e in entries:
                    if directory == unit.path and not unit.has(e.name):
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if unit.deep and self._may_hold(e.path):
                            stack.append(e.path)
                        continue
                    if not all(any(e.path.startswith(x) for x in some) for some in self.beginnings):
                        continue
                    regular = e.is_file()
                    if self.is_file is not None and regular != self.is_file:
                        continue
                    row = (e.path, e.stat().st_size if regular else None, regular)
                    if self.content:
                        data = None
                        if regular:
                            try:
                                with open(e.path, "rb") as f:
                                    data = f.read()
                            except OSError:
                                pass
                        row += (data,)
                    yield row


class FileInventory(DataSource):
    """``spark.read.format("file_inventory").option("columns", "content").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self.options.get("columns") == "content" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """A directory tree as an inventory. With ``content``, small files' bytes come along; ``sources.content`` reads large ones in place."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileInventory)
    return spark.read.format("file_inventory").option("columns", "content" if content else "listing").load(root)


def listed(directories: DataFrame) -> DataFrame:
    """path of the leaves of the directories (one column) themselves, each listed once by the executors; one that isn't there has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                try:
                    with os.scandir(directory or "/") as entries:
                        while some := list(islice(entries, LOOKED_AT)):
                            yield pa.record_batch([pa.array([e.path for e in some if not e.is_dir(follow_symlinks=False)], pa.string())], names=["path"])
                except (FileNotFoundError, NotADirectoryError):
                    continue

    return directories.distinct().mapInArrow(run, "path string")


def from_table(df: DataFrame, path: Column, content: Column | None = None, exif: Column | None = None) -> DataFrame:
    """Any table as an inventory: path, and content or exif where given."""
    columns = [path.alias("path")] + [c.alias(n) for n, c in (("content", content), ("exif", exif)) if c is not None]
    return df.select(*columns)


def scan_order(inventory: DataFrame) -> DataFrame:
    """The defined order of a scan: by path. Adds the name parts."""
    return decomposed(inventory).orderBy("path")


def probe(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds exists: whether the path is in the inventory."""
    there = inventory.select("path").distinct().withColumn("exists", F.lit(True))
    return paths.join(there, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

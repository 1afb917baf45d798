"""What is read of files' bytes, on the executors and after the filter on names: a content key, or EXIF fields.

Bytes never leave the task that reads them, so a file may be larger than a row could be. Content is told apart in tiers: by size, then by a hash of head and tail, then by
a hash of the whole, each only among files that the tier before couldn't tell apart. So a file whose size no other file has is never opened, nor is an empty one.
"""

from __future__ import annotations

import hashlib
import mmap
import os
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.operators.staging import written
from filewright.sources.exif import SCHEMA, capture_fields

CHUNK = 1 << 22
#: Bytes of a file's head, and of its tail, that the second tier reads.
EDGE = 1 << 16


def hash_of(path: str) -> str | None:
    """SHA-256 of a file in hexadecimal digits; None if it can't be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
    except OSError:
        return None
    return digest.hexdigest()


def edges_of(path: str, edge: int) -> str | None:
    """SHA-256 of a file's head and tail (of all of it, if it is no longer than both); None if it can't be read."""
    try:
        with open(path, "rb") as f:
            digest = hashlib.sha256(f.read(edge))
            size = f.seek(0, os.SEEK_END)
            f.seek(max(min(edge, size), size - edge))
            digest.update(f.read(edge))
    except OSError:
        return None
    return digest.hexdigest()


def readable(path: str) -> str | None:
    """An empty text for a file that may be read; it isn't opened."""
    return "" if os.access(path, os.R_OK) else None


def _told(files: DataFrame, how: Callable[[str], str | None]) -> DataFrame:
    """``files`` (path, length, ...) with ``told``: what ``how`` says of the path."""
    names = [*files.columns, "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                yield pa.record_batch([*some.columns, pa.array([how(p) for p in some.column(0).to_pylist()], pa.string())], names=names)

    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", told string")


def content_tiers(files: DataFrame) -> DataFrame:
    """path, content_hash and tier (0: not opened, 1: head and tail read, 2: all read) of a listing (path, length, is_file).

    content_hash is equal where contents are, null where a file can't be read. The listing, and what the second tier has read, are written once; sizes that very many
    files share meet their counts in joins that Spark can split.
    """
    listing = written(files.select("path", "length", "is_file"), "listing")
    regular = listing.where("is_file and length > 0").select("path", "length")
    sizes = regular.groupBy("length").agg(F.count("*").alias("n"))
    sized = regular.join(sizes, "length").select("path", "length", "n")
    size = F.col("length").cast("string")
    alone = _told(sized.where("n = 1").select("path", "length").unionByName(listing.where("is_file and length = 0").select("path", "length")), readable)
    first = alone.select("path", F.when(F.col("told").isNotNull(), size).alias("content_hash"), F.lit(0).alias("tier"))
    read = written(_told(sized.where("n > 1").select("path", "length"), partial(edges_of, edge=EDGE)), "edges")
    more = read.where(F.col("told").isNotNull() & (F.col("length") > 2 * EDGE)).groupBy("length", "told").agg(F.count("*").alias("n")).where("n > 1").select("length", F.col("told").alias("edge"))
    met = read.join(more.withColumnRenamed("length", "more_length"), (F.col("length") == F.col("more_length")) & (F.col("told") == F.col("edge")), "left")
    key = F.concat(size, F.lit("-"), "told")
    second = met.where("edge is null").select("path", key.alias("content_hash"), F.lit(1).alias("tier"))
    whole = _told(met.where("edge is not null").select("path", "length", "edge"), hash_of)
    third = whole.select("path", F.concat(size, F.lit("-"), "edge", F.lit("-"), "told").alias("content_hash"), F.lit(2).alias("tier"))
    others = listing.where("not is_file").select("path", F.lit(None).cast("string").alias("content_hash"), F.lit(0).alias("tier"))
    return first.unionByName(second).unionByName(third).unionByName(others)


def exif_of(path: str) -> tuple[str | None, str | None]:
    """A file's two EXIF fields, through a memory map; None where it can't be read or has none."""
    try:
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return capture_fields(data)
    except (OSError, ValueError):  # an empty file can't be mapped
        return None, None


def with_read(files: DataFrame, what: str) -> DataFrame:
    """``files`` with ``content_hash``, or with ``exif`` and its two fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                paths = some.column(0).to_pylist()
                if what == "content_hash":
                    yield pa.record_batch([some.column(0), pa.array([hash_of(p) for p in paths], pa.string())], names=["path", "content_hash"])
                else:
                    dates, subs = zip(*map(exif_of, paths), strict=True)
                    yield pa.record_batch([some.column(0), pa.array(dates, pa.string()), pa.array(subs, pa.string())], names=["path", "date_time_original", "sub_sec_time_original"])

    paths = files.select("path")
    if what == "content_hash":
        return paths.mapInArrow(run, "path string, content_hash string")
    return paths.mapInArrow(run, f"path string, {SCHEMA}").select("path", F.struct("date_time_original", "sub_sec_time_original").alias("exif"))

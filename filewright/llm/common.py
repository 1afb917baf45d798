"""What the operators of this subpackage share: the shared folder, written tables, column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only on one machine (tests), where the session names no such folder, is a temporary one made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and reread: lineage ends here."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a frame that ``staged`` returned."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Plans of these nodes read files as they are.
REPEATABLE = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "View"}
#: Files up to which their numbers are broadcast (16 bytes each); those of more are joined in a shuffle.
NUMBERED_FILES = 1 << 20


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` if it is a scan of Parquet files, with projections and filters; else ``df`` written once.

    Operators that know rows by their number read their input through this: a row's place in its file is the same whenever the frame
    runs, while its place in the scan, or in any other plan, changes with the cores that are there.
    """
    nodes, stack = set(), [df._jdf.queryExecution().analyzed()]
    plan, formats = stack[0], set()
    while stack:
        node = stack.pop()
        nodes.add(node.nodeName())
        if node.nodeName() == "LogicalRelation":
            relation = node.relation()
            formats.add(relation.fileFormat().toString() if relation.getClass().getSimpleName() == "HadoopFsRelation" else "")
        below = node.children()
        stack += [below.apply(i) for i in range(below.size())]
    plain = nodes <= REPEATABLE and formats == {"Parquet"} and plan.deterministic()
    return df if plain else staged(df, "input")


#: Schemes that Hadoop and pyarrow name differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(uri: str) -> str:
    """A Hadoop address as pyarrow takes it."""
    scheme, colon, rest = uri.partition(":")
    return ARROW_SCHEMES.get(scheme, scheme) + colon + rest


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder; local folders can be memory-mapped."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(arrow_uri(uri))


def slices(batch: pa.RecordBatch, texts: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and bytes in the column ``texts`` (or one row)."""
    ends = np.cumsum(pc.binary_length(batch.column(texts)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(at + rows, max(at + 1, fit))
        yield batch.slice(at, end - at)
        at = end


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches; then what it has freed goes back to the system, as worker processes stay."""

    def to_end(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return to_end


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """A ``repeatable`` frame with its rows' numbers, and their column's name: the file's number (by name) and the row's in the file."""
    row, file, number = (unused(df, name) for name in ("row", "file_hash", "file_number"))
    meta = df.metadataColumn("_metadata")
    paths = sorted(r[0] for r in df.select(meta["file_path"]).distinct().collect())  # reads no column
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), f"{number} long, path string").select(F.xxhash64("path").alias(file), number)
    files = F.broadcast(files) if len(paths) <= NUMBERED_FILES else files
    placed = df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row)).join(files, file)
    return placed.withColumn(row, F.shiftleft(number, 33) + F.col(row)).drop(file, number), row


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of a thousand shares, one: a key is hot if it holds more of the rows, so there are at most a thousand hot keys.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row a key and the key's number of left rows in ``size``.

    The hot keys' rows, a thousand at most by their share of ``total``, are broadcast; the others meet in a shuffle that no key dominates.
    """
    is_hot = F.col(size) * HOT_SHARE > total
    hot = right.where(is_hot)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return left.join(right, key)
    in_hot = F.col(key).isin(keys)
    return left.where(in_hot).join(F.broadcast(hot), key).unionByName(left.where(~in_hot).join(right.where(~is_hot), key))

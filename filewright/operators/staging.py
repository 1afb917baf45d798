"""Frames written once into the shared folder, so that lineage ends and a scan isn't done again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine without that setting (tests), below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Folders written within each ``temporary`` that is open.
_within: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at its end, when nothing that is kept depends on it."""
    _within.append([])
    try:
        yield
    finally:
        for folder in _within.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and reread."""
    path = shared_folder(df.sparkSession, label)
    if _within:
        _within[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int | None:
    """What the optimizer takes the frame's size to be, without a job; None where it can't know (rows given by hand or from an RDD)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() in ("LogicalRDD", "LocalRelation"):
            return None
        below = node.children()
        stack += [below.apply(i) for i in range(below.size())]
    return int(str(plan.stats().sizeInBytes()))

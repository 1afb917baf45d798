"""The generic operations on collections of files: filter, sort, slice, union, look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.operators.staging import written


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def filename_matches(df: DataFrame, java: str) -> DataFrame:
    """Rows whose file name (not path) matches somewhere."""
    return df.where(F.col("filename").rlike(java))


def with_upper_case(df: DataFrame) -> DataFrame:
    return filename_matches(df, "[A-Z]")


def _placed(df: DataFrame, order: list[str], rank: str) -> tuple[DataFrame, int]:
    """The sorted rows, written once, with their ranks, and their number. A rank is the row's place in its range plus the rows of the ranges before."""
    rows = written(df.orderBy(*order).withColumn(rank, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(rank, 33)
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())  # one row a range
    bases, n = [], 0
    for number, size in sizes:
        bases.append((number, n))
        n += size
    bases = F.broadcast(df.sparkSession.createDataFrame(bases, "_part long, _base long"))
    place = F.col("_base") + F.col(rank).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(bases, part == F.col("_part")).withColumn(rank, place).drop("_part", "_base"), n


def ranked(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Adds each row's place in the order, from 0. Rows are sorted by ranges and written once; nothing meets in one task."""
    return _placed(df, order, rank)[0]


def sliced(df: DataFrame, order: list[str], offset: int, length: int | None = None, rank: str | None = None) -> DataFrame:
    """Rows from an offset on, in order; a negative offset counts from the end, a negative length leaves so many at the end. ``rank`` keeps their places by that name."""
    name = rank or "_rank"
    rows, n = _placed(df, order, name)
    begin = max(0, n + offset) if offset < 0 else offset
    end = n if length is None else (n + length if length < 0 else begin + length)
    rows = rows.where((F.col(name) >= begin) & (F.col(name) < end)).orderBy(name)
    return rows if rank else rows.drop(name)


def appended(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other)


def looked_up(df: DataFrame, column: str, keys: list) -> DataFrame:
    return df.where(F.col(column).isin(keys))


def without(df: DataFrame, other: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose key isn't in the other frame."""
    return df.join(other.select(column), column, "left_anti")

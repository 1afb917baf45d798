"""Group keys: what makes two files duplicates. Each takes an inventory with target columns and returns a column; null drops the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target_path_key() -> Column:
    """Duplicates within one directory."""
    return F.col("target_path")


def target_filename_key() -> Column:
    """Duplicates across directories, by target name."""
    return F.concat(F.col("t_stem"), F.lit("."), F.col("t_ext"))


def content_key(column: str = "content") -> Column:
    """Duplicates across directories, by content. The hash is taken before any shuffle; the key is only compared."""
    return F.sha2(F.col(column).cast("binary"), 256)

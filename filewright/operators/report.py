"""Counts and report lines over inventories and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(plan: DataFrame) -> DataFrame:
    """One row: groups, widest source path in bytes, possible duplicates (skipped ones too), files renamed or copied."""
    return plan.agg(
        F.countDistinct("group_key").alias("n_groups"),
        F.max(F.octet_length("source_path")).alias("max_source_bytes"),
        F.count_if("is_duplicate").alias("n_duplicates"),
        F.count_if(F.col("action") != "skip").alias("n_files"),
    )


def lines(plan: DataFrame) -> DataFrame:
    """source_path and line: the source padded to the widest (in bytes), an arrow, the target."""
    widest = plan.agg(F.max(F.octet_length("source_path")).alias("width"))  # one row
    padded = F.concat("source_path", F.repeat(F.lit(" "), (F.col("width") - F.octet_length("source_path")).cast("int")))
    return plan.join(F.broadcast(widest)).select("source_path", F.concat(padded, F.lit(" → "), "target_path").alias("line"))

"""Companion files: the video half of a live photo, or a raw file, beside a grouped image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.functions import names as N
from filewright.operators.plan import COLUMNS, divided, over_groups


def companion_target(dir_="dir", stem="t_stem", ext="ext"):
    """A companion's target: its own directory and extension, the group's stem."""
    return F.concat(dir_, F.lit("/"), stem, F.lit("."), ext)


def companion_key(stem="t_stem", ext="ext"):
    """A companion's key: the group's stem with its own extension."""
    return F.concat(stem, F.lit("."), ext)


def with_companions(rows: DataFrame) -> DataFrame:
    """Grouped files (phase 0), and their companions (phase 1): files in no group that share a grouped file's path without extension.

    rows: all files with targets, group_key null where a file is in no group. A companion takes the stem of its group's first target, and its
    key is that stem with its own extension. A file that meets several groups joins the first, by the groups' first paths. Two windows
    do it, over the key (files without one are spread by path; large inventories are divided, see ``operators.plan``) and over the path without extension, so
    files are read once.
    """
    keyed = divided(rows).withColumns({"own_key": F.col("group_key"), "group_key": F.coalesce("group_key", F.concat(F.lit("\0"), "path"))})
    first = over_groups(keyed, first={"group_first": F.col("path"), "g_stem": F.col("t_stem")}).withColumns({"group_key": F.col("own_key"), "pair": N.pair_stem(F.col("path"))})
    mate = F.when(F.col("group_key").isNotNull(), F.struct("group_first", "path", "g_stem"))
    met = first.withColumn("mate", F.min(mate).over(Window.partitionBy("pair"))).where("group_key is not null or mate is not null")
    alone = F.col("group_key").isNull()
    stem = F.when(alone, F.col("mate.g_stem")).otherwise(F.col("t_stem"))
    ext = F.when(alone, F.col("ext")).otherwise(F.col("t_ext"))
    met = met.withColumns({"t_stem": stem, "t_ext": ext, "phase": alone.cast("int"), "group_key": F.when(alone, companion_key(stem, F.col("ext"))).otherwise(F.col("group_key"))})
    return met.select(*COLUMNS)

"""File names and paths as columns. All take and return columns and run in the JVM.

Each uses its argument once where it can: Spark puts columns into one another, and what is used thrice at every level would grow without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.patterns import group_count, java_regex, java_replacement

MARKER = "-duplicate-"


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot; empty without one."""
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def stem(name: Column) -> Column:
    """The name without its extension, unless that is all of it (``.hidden``)."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")


def decomposed(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds dir, filename, stem and ext."""
    df = df.withColumns({"dir": directory(F.col(path)), "filename": filename(F.col(path))})
    return df.withColumns({"stem": stem(F.col("filename")), "ext": extension(F.col("filename"))})


def without_marker(stem_: Column) -> Column:
    """The stem without a duplicate number of exactly three digits at its end."""
    return F.regexp_replace(stem_, f"{MARKER}[0-9]{{3}}$", "")


def joined(stem_: Column, ext: Column, strict: bool = True) -> Column:
    """Stem, dot and extension. Where that isn't ``strict``, a name without extension stays without a dot, and so does one that is all extension (``.hidden``)."""
    name = F.concat(stem_, F.lit("."), ext)
    return name if strict else F.when((ext == "") | (F.regexp_replace(stem_, f"{MARKER}[0-9]+$", "") == F.concat(F.lit("."), ext)), stem_).otherwise(name)


def inherited(stem_: Column, ext: Column, strict: bool = True) -> Column:
    """The name without a duplicate number. A name without extension gains a dot, and ``.hidden`` becomes ``.hidden.hidden``, unless that isn't ``strict``."""
    return joined(without_marker(stem_), ext, strict)


def lower_case(stem_: Column, ext: Column, strict: bool = True) -> Column:
    return F.lower(inherited(stem_, ext, strict))


def replaced(stem_: Column, ext: Column, pattern: str, replacement: str, strict: bool = True) -> Column:
    """All matches of a delimited pattern replaced; unchanged without a match."""
    java = java_regex(pattern)
    return F.regexp_replace(inherited(stem_, ext, strict), F.lit(java), F.lit(java_replacement(replacement, group_count(java))))


def target_directory(dir_: Column, source_root: str, target_root: str) -> Column:
    """The directory below the target root: the source root's text is removed wherever it stands."""
    inner = F.trim(F.replace(dir_, F.lit(source_root), F.lit("")), F.lit("/"))
    return F.rtrim(F.concat(F.lit(target_root + "/"), inner), F.lit("/"))


def target_path(dir_: Column, name: Column, source_root: str, target_root: str) -> Column:
    return F.concat(target_directory(dir_, source_root, target_root), F.lit("/"), name)


def duplicate_name(stem_: Column, number: Column, ext: Column, strict: bool = True) -> Column:
    """Three digits at least; more from 1000 on."""
    return joined(F.concat(stem_, F.lit(MARKER), F.format_string("%03d", number)), ext, strict)


def is_duplicate(name: Column) -> Column:
    return F.contains(name, F.lit(MARKER))


def pair_stem(path: Column) -> Column:
    """The path without extension, by which an image and its companion meet; unchanged without one."""
    ext = extension(filename(path))
    return F.when(ext == "", path).otherwise(F.left(path, F.length(path) - F.length(ext) - 1))

"""The five commands: each is a scan, a new name, a group key and options, and gives a plan."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.functions import dates, keys, names
from filewright.functions.patterns import date_pattern, java_regex
from filewright.operators.collection import filename_matches
from filewright.operators.journal import new_journal, write_plan, written_plan
from filewright.operators.pairing import with_companions
from filewright.operators.plan import rename_plan, resolved, with_targets
from filewright.operators.sink import Outcome, apply_on_executors, apply_plan
from filewright.operators.staging import temporary, written
from filewright.plans.options import RenameOptions
from filewright.sources import content, inventory

#: The commands' default options.
DEFAULT_PATTERN, DEFAULT_REPLACEMENT = "/^(.+)(jpeg)$/", "$1jpg"
DEFAULT_DATE_PATTERN, DEFAULT_DATE_REPLACEMENT = "/^{y}-{m}-{d}.{H}-{i}-{s}(.+)$/", "{Y}-{m}-{d}_{H}-{i}-{s}"


@dataclass(frozen=True)
class RenameQuery:
    """new_name and key are columns over an inventory with name parts (new_name) and targets (key); null drops a row.

    expand may add rows after grouping: it gets all files, with null targets where a file is in no group, and returns the grouped ones;
    own_extension keeps each file's extension; filename_regex filters the scan by raw names; reads says what is read of a file's bytes
    (``content_hash`` or ``exif``).
    """

    new_name: Column
    key: Column
    options: RenameOptions
    filename_regex: str | None = None
    own_extension: bool = False
    nullable_key: bool = True
    expand: Callable[[DataFrame], DataFrame] | None = None
    reads: str | None = None
    nullable_name: bool = False

    def rows(self, files: DataFrame) -> DataFrame:
        scanned = files
        if self.filename_regex is not None:
            scanned = filename_matches(names.decomposed(files), self.filename_regex).select(*files.columns)
        if self.reads == "content_hash" and "content_hash" not in files.columns:
            scanned = scanned.withColumn("content_hash", keys.content_key())
        rows = with_targets(scanned, self.new_name, self.key, self.options.source_dir, self.options.target_root, self.nullable_key, self.expand is not None, self.nullable_name)
        return self.expand(rows) if self.expand else rows

    def scan(self, spark: SparkSession) -> DataFrame:
        """The source directory as the inventory that this command needs: only files whose names pass are opened.

        Keys of contents are written once, so bytes are read once whatever becomes of the executors.
        """
        files = inventory.scan(spark, self.options.source_dir)
        if self.filename_regex is not None:
            files = filename_matches(names.decomposed(files), self.filename_regex).where("is_file").select(*files.columns)
        if self.reads == "content_hash":
            return written(content.content_tiers(files).drop("tier"), "content")
        return content.with_read(files, self.reads) if self.reads else files

    def plan(self, files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
        """existing: paths in the target tree at planning time, unfiltered.

        In place these are ``files`` themselves unless given; of another target, the directories that the plan names are listed unless given.
        """
        o = self.options
        if existing is None:
            existing = files.select("path") if o.target_root == o.source_dir else self.on_disk(files)
        plan = rename_plan(self.rows(files), o.source_dir, o.target_root, existing, self.own_extension, o.skip_duplicates, o.copy, o.strict_names)
        return resolved(plan, existing, o.skip_duplicates) if o.distinct_targets else plan

    def on_disk(self, files: DataFrame) -> DataFrame | None:
        """The paths in the directories that targets of ``files`` lie in; no other directory of the target tree is listed. None if there is no target tree."""
        o = self.options
        if not os.path.isdir(o.target_root or "/"):
            return None
        return inventory.listed(files.select(names.target_directory(names.directory(F.col("path")), o.source_dir, o.target_root).alias("dir")))

    def run(self, spark: SparkSession, journal: str | None = None, on_executors: bool = False) -> tuple[DataFrame, Outcome | DataFrame | None]:
        """Scans, plans and, unless it is a dry run, carries the plan out; returns the plan and what was done.

        The plan is written into the journal (a new one unless given) before the first file moves, and is returned as written. With the journal of a run
        that was killed, nothing is scanned or planned: that run's plan is carried on.
        """
        folder = journal or new_journal(spark)
        plan = written_plan(spark, folder)
        if plan is None:
            with temporary(spark):
                files = self.scan(spark)
                plan = write_plan(self.plan(files, self.on_disk(files)), folder)
        if self.options.dry_run:
            return plan, None
        return plan, apply_on_executors(plan, journal=folder) if on_executors else apply_plan(plan, journal=folder)


def _parts() -> tuple[Column, Column]:
    return F.col("stem"), F.col("ext")


def lower(options: RenameOptions) -> RenameQuery:
    return RenameQuery(names.lower_case(*_parts(), options.strict_names), keys.target_path_key(), options, nullable_key=False)


def pattern(options: RenameOptions, pattern: str = DEFAULT_PATTERN, replacement: str | None = DEFAULT_REPLACEMENT) -> RenameQuery:
    if replacement is None:
        raise ValueError("a replacement is needed")
    return RenameQuery(names.replaced(*_parts(), pattern, replacement, options.strict_names), keys.target_path_key(), options, java_regex(pattern), nullable_key=False)


def date(options: RenameOptions, pattern: str = DEFAULT_DATE_PATTERN, replacement: str | None = DEFAULT_DATE_REPLACEMENT) -> RenameQuery:
    if replacement is None:
        raise ValueError("a replacement is needed")
    return RenameQuery(dates.date_renamed(*_parts(), pattern, replacement, options.strict_names), keys.target_path_key(), options, date_pattern(pattern).java, nullable_key=False)


def content_hash(options: RenameOptions) -> RenameQuery:
    """The inventory has the content, or a content_hash worked out where the bytes are."""
    return RenameQuery(names.inherited(*_parts(), options.strict_names), F.col("content_hash"), options, reads="content_hash")


def exif_date(options: RenameOptions, target_filename_pattern: str = dates.DEFAULT_CAPTURE_FORMAT) -> RenameQuery:
    """The inventory has an exif struct; see sources.exif."""
    name = dates.capture_renamed(F.col("exif.date_time_original"), F.col("exif.sub_sec_time_original"), F.col("ext"), target_filename_pattern, options.strict_names)
    return RenameQuery(name, keys.target_filename_key(), options, own_extension=True, nullable_key=False, expand=with_companions, reads="exif", nullable_name=True)


#: By the commands' names.
COMMANDS: dict[str, Callable[..., RenameQuery]] = {"rename:lower": lower, "rename:pattern": pattern, "rename:date-pattern": date, "rename:hash": content_hash, "rename:exifdate": exif_date}

"""Command line: ``python -m filewright rename:hash SOURCE [TARGET] [--dry-run] [--copy] [--skip-duplicates] [options of the command]``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from filewright.functions import dates
from filewright.functions.patterns import PatternError
from filewright.operators import report
from filewright.operators.journal import PlanError, new_journal
from filewright.plans import commands
from filewright.plans.options import RenameOptions


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="filewright", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("source_directory")
    common.add_argument("target_directory", nargs="?")
    common.add_argument("-d", "--dry-run", action="store_true")
    common.add_argument("-c", "--copy", action="store_true")
    common.add_argument("-s", "--skip-duplicates", action="store_true")
    common.add_argument("--no-strict-names", action="store_true", help="names without extension stay without a dot")
    common.add_argument("--distinct-targets", action="store_true", help="files that would share a target get further numbers")
    common.add_argument("-j", "--journal", help="folder of the plan and of what was done; with that of a run that was killed, goes on with it")
    names = parser.add_subparsers(dest="command", required=True)
    for name in commands.COMMANDS:
        own = names.add_parser(name, parents=[common])
        if name == "rename:pattern":
            own.add_argument("-p", "--pattern", default=commands.DEFAULT_PATTERN)
            own.add_argument("-r", "--replacement", default=commands.DEFAULT_REPLACEMENT)
        elif name == "rename:date-pattern":
            own.add_argument("-p", "--pattern", default=commands.DEFAULT_DATE_PATTERN)
            own.add_argument("-r", "--replacement", default=commands.DEFAULT_DATE_REPLACEMENT)
        elif name == "rename:exifdate":
            own.add_argument("-fp", "--target-filename-pattern", default=dates.DEFAULT_CAPTURE_FORMAT)
    return parser.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the plan's lines and counts; 0 if all went well. A real run needs no further consent: the dry run is there to look first."""
    asked = vars(arguments(sys.argv[1:] if args is None else args))
    own = {k: asked[k] for k in ("pattern", "replacement", "target_filename_pattern") if k in asked}
    try:
        options = RenameOptions(asked["source_directory"], asked["target_directory"], asked["copy"], asked["skip_duplicates"], asked["dry_run"], not asked["no_strict_names"], asked["distinct_targets"])
        command = commands.COMMANDS[asked["command"]](options, **own)
        spark = spark or SparkSession.builder.appName("filewright").getOrCreate()
        journal = asked["journal"] or new_journal(spark)
        plan, _ = replace(command, options=replace(options, dry_run=True)).run(spark, journal)  # what is printed is what is done
        for row in report.lines(plan).toLocalIterator():
            print(row.line)
        counts = report.summary(plan).first()
        print(f"{counts.n_groups} groups, {counts.n_duplicates} possible duplicates, {counts.n_files} files{' (dry run)' if options.dry_run else ''}")
        if not options.dry_run:
            command.run(spark, journal)
    except (ValueError, PatternError, PlanError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""What a command is given."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RenameOptions:
    """source_dir and target_dir lose trailing slashes; without a target the source is renamed in place. A dry run only plans.

    With strict_names every new name has a dot and an extension, so ``README`` becomes ``README.`` and ``.hidden`` becomes ``.hidden.hidden``; without, such names stay as they are.
    With distinct_targets, files of several groups that would share a target, or meet a number that is taken, get further numbers; else the sink refuses them.
    """

    source_dir: str
    target_dir: str | None = None
    copy: bool = False
    skip_duplicates: bool = False
    dry_run: bool = True
    strict_names: bool = True
    distinct_targets: bool = False

    def __post_init__(self):
        if self.target_dir is None and (self.copy or self.skip_duplicates):
            raise ValueError("copy and skip_duplicates need a target directory")
        object.__setattr__(self, "source_dir", self.source_dir.rstrip("/"))

    @property
    def target_root(self) -> str:
        return self.source_dir if self.target_dir is None else self.target_dir.rstrip("/")

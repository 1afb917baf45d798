"""A plan's journal: the plan written once, the order of its moves, and a log of what was begun and done.

Folder (on the file system of the tree, which driver and executors share)::

    plan/      the plan as it was when it was made, Parquet; nothing reads the tree again
    steps/     the plan's steps: wave, task, chain, depth, step_source, step_target, source_path, ...
    log/       for each task and attempt, lines of JSON: {"at": source, "wave": 1, "state": "started" | "done" | "failed", ...}
    outcome/   for each wave that has ended, a row a step

A step is ``started`` in the log before its file is touched and ``done`` after. Whoever carries a task out, after a crash or a lost executor, reads that
task's logs first: done and failed steps are left alone, and one that was started is judged by the disk. A target appears whole (bytes that have to be copied are
copied to a passing name beside it, which is then renamed), so if the source is gone and the target there it was done; if both are there the target is
the step's own, as it had been free at the start, and the source goes; if only the source is there it is done again.

Order: a move whose target is another move's source waits for that move. Such moves form chains and cycles, as no two steps share a source or a target.
Pointer jumping finds each row's distance from its chain's end. One move of a cycle, and each ``SEGMENT``-th of a chain, is first taken
to a passing name (wave 0); then all segments run side by side, each in order (wave 1); then what was passed gets its target (wave 2).
"""

from __future__ import annotations

import filecmp
import json
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.operators.plan import with_collisions

#: Moves of a chain that one task does in order.
SEGMENT = 1000
WAVES = (0, 1, 2)
DONE = "source_path string, target_path string, wave int, failure string"


class PlanError(RuntimeError):
    """A file of a plan could not be moved or copied."""


def new_journal(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        parsed = urlparse(base)
        if parsed.scheme not in ("", "file"):
            raise ValueError(f"name a journal folder on the tree's file system; {base!r} is on another")
        return f"{parsed.path.rstrip('/')}/journal-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("name a journal folder that driver and executors share")
    return tempfile.mkdtemp(prefix="journal-")


def _table(spark: SparkSession, folder: str, name: str, make=None) -> DataFrame:
    """A table of the journal, written first if it isn't there whole."""
    path = f"{folder}/{name}"
    if make is not None and not os.path.exists(f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(f"file://{path}")
    return spark.read.parquet(f"file://{path}")


def write_plan(plan: DataFrame | None, folder: str, spark: SparkSession | None = None) -> DataFrame:
    """The plan as it stands in the journal; written if the journal has none yet. From here on nothing looks at the tree to plan."""
    return _table(spark or plan.sparkSession, folder, "plan", None if plan is None else lambda: plan)


def written_plan(spark: SparkSession, folder: str) -> DataFrame | None:
    """The plan that a journal has; None if there is none, or not all of it."""
    return _table(spark, folder, "plan") if os.path.exists(f"{folder}/plan/_SUCCESS") else None


def _moved_first(moves: DataFrame, folder: str) -> DataFrame | None:
    """chain, depth and passes of the moves (source_path) that wait for another or are waited for; None if no move's target is a source.

    depth: moves of the chain that come before; passes: whether the move goes by a passing name.
    """
    blockers = moves.select(F.col("source_path").alias("next"))
    edges = moves.join(blockers, moves.target_path == blockers.next).where("source_path <> target_path").select(F.col("source_path").alias("id"), "next")
    edges = _table(moves.sparkSession, folder, "work/edges", lambda: edges)
    n = edges.count()
    if not n:
        return None
    rounds = math.ceil(math.log2(n + 1)) + 1

    def jumped(edges: DataFrame, label: str) -> DataFrame:
        """id, root (the chain's end; null in a cycle), dist to it, least id met."""
        state = edges.select("id", "next", F.lit(1).cast("long").alias("dist"), F.least("id", "next").alias("least"), F.lit(None).cast("string").alias("root"))
        for k in range(rounds):
            own = _table(edges.sparkSession, folder, f"work/{label}-{k}", lambda state=state: state)
            if own.where("root is null").isEmpty():
                return own
            further = own.select(F.col("id").alias("f_id"), F.col("next").alias("f_next"), F.col("dist").alias("f_dist"), F.col("least").alias("f_least"), F.col("root").alias("f_root"))
            met = own.join(further, (F.col("next") == F.col("f_id")) & F.col("root").isNull(), "left")
            ends, moves_on = F.col("root").isNull() & F.col("f_id").isNull(), F.col("root").isNull() & F.col("f_id").isNotNull()
            state = met.select(
                "id", F.when(moves_on, F.col("f_next")).otherwise(F.col("next")).alias("next"), F.when(moves_on, F.col("dist") + F.col("f_dist")).otherwise(F.col("dist")).alias("dist"),
                F.when(moves_on, F.least("least", "f_least")).otherwise(F.col("least")).alias("least"), F.when(ends, F.col("next")).when(moves_on, F.col("f_root")).otherwise(F.col("root")).alias("root"),
            )
        return _table(edges.sparkSession, folder, f"work/{label}-{rounds}", lambda: state)

    found = jumped(edges, "chains")
    chains = found.where("root is not null").select("id", "root", "dist")
    heads = chains.select(F.col("root").alias("id"), "root", F.lit(0).cast("long").alias("dist")).distinct()
    placed = chains.unionByName(heads).select(F.col("id").alias("source_path"), F.col("root").alias("chain"), F.col("dist").alias("depth"), F.lit(False).alias("breaks"))
    cycles = found.where("root is null")
    if not cycles.isEmpty():
        breakers = cycles.where("id = least").select(F.col("id").alias("source_path"), F.col("id").alias("chain"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("breaks"))
        opened = jumped(edges.join(cycles.where("id <> least").select("id"), "id", "left_semi"), "cycles")  # their chains end at the move that is passed
        rest = opened.select(F.col("id").alias("source_path"), F.col("root").alias("chain"), (F.col("dist") - 1).alias("depth"), F.lit(False).alias("breaks"))
        placed = placed.unionByName(breakers).unionByName(rest)
    passes = F.col("breaks") | ((F.col("depth") > 0) & (F.col("depth") % SEGMENT == 0))
    return placed.select("source_path", F.concat("chain", F.lit("\0"), F.floor(F.col("depth") / SEGMENT).cast("string")).alias("chain"), "depth", passes.alias("passes"))


def passing_name(path: Column) -> Column:
    """The name in the source's folder that a move may go by; the same whenever it is asked for."""
    return F.concat(F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1), F.lit(".passing-"), F.sha2(path, 256))


def steps(plan: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """The journal's steps of its written plan, made if they aren't there. Skipped rows have none; rows that are refused say why."""
    spark = plan.sparkSession

    def make() -> DataFrame:
        rows = with_collisions(plan.where("action <> 'skip'"))
        clash = F.when(F.col("collision") & F.lit(not overwrite), F.concat(F.lit("several files would become "), "target_path"))
        rows = rows.select("source_path", "target_path", "action", "group_key", "idx", clash.alias("refused"))
        order = _moved_first(rows.where("action = 'move' and refused is null").select("source_path", "target_path"), folder)
        if order is None:
            rows = rows.withColumns({"chain": F.col("source_path"), "depth": F.lit(0).cast("long"), "passes": F.lit(False)})
        else:
            rows = rows.join(order, "source_path", "left").withColumns({"chain": F.coalesce("chain", "source_path"), "depth": F.coalesce("depth", F.lit(0)), "passes": F.coalesce("passes", F.lit(False))})
        by = passing_name(F.col("source_path"))
        direct = rows.where("not passes").withColumns({"wave": F.lit(1), "step_source": F.col("source_path"), "step_target": F.col("target_path")})
        if order is not None:
            passing = rows.where("passes")
            direct = direct.unionByName(passing.withColumns({"wave": F.lit(0), "step_source": F.col("source_path"), "step_target": by}))
            direct = direct.unionByName(passing.withColumns({"wave": F.lit(2), "step_source": by, "step_target": F.col("target_path")}))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
        return direct.withColumn("task", F.pmod(F.xxhash64("chain"), F.lit(tasks)).cast("int"))

    return _table(spark, folder, "steps", make)


class Log:
    """What was begun and done of a task's steps. ``durable`` waits for the disk at each start."""

    def __init__(self, folder: str, wave: int, task: str, attempt: str, durable: bool = True):
        self.wave, self.durable, place = wave, durable, f"{folder}/log/{task}"
        os.makedirs(place, exist_ok=True)
        self.states: dict[str, tuple[str, str | None]] = {}
        for name in sorted(os.listdir(place)):
            with open(f"{place}/{name}", encoding="utf-8", errors="surrogateescape") as f:
                for line in f:
                    if line.endswith("\n"):  # else its writer died within it
                        entry = json.loads(line)
                        if entry["wave"] == wave and self.states.get(entry["at"], ("",))[0] != "done":
                            self.states[entry["at"]] = entry["state"], entry.get("why")
        self.file = os.open(f"{place}/{wave}-{attempt}.log", os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o644)

    def write(self, source: str, state: str, why: str | None = None) -> None:
        entry = {"at": source, "wave": self.wave, "state": state} | ({"why": why} if why else {})
        os.write(self.file, (json.dumps(entry) + "\n").encode())
        if self.durable and state == "started":
            os.fsync(self.file)

    def close(self) -> None:
        os.close(self.file)


def _same_name(source: str, target: str) -> bool:
    """Whether both are one entry of a file system that ignores case; links to one file are two entries."""
    return os.path.exists(target) and os.path.samefile(source, target) and not os.path.islink(source) and not os.path.islink(target) and os.stat(source).st_nlink == 1


def transfer(source: str, target: str, copy: bool = False, overwrite: bool = False) -> None:
    """Moves or copies a file; makes the target's directory. Refuses what isn't a file, a target that can't be written, and, unless told, one that is there.

    A target appears whole: bytes are copied to a passing name beside it first.
    """
    folder = os.path.dirname(target)
    try:
        os.makedirs(folder, 0o755, exist_ok=True)
    except OSError as e:
        raise PlanError(f"directory {folder!r} was not created: {e}") from e
    if not copy and not os.path.lexists(source) and os.path.isfile(target):
        return
    if not os.path.isfile(source) or (os.path.isfile(target) and not os.access(target, os.W_OK)):
        raise PlanError(f"{source!r} can't be written to {target!r}")
    if source == target:
        return
    if os.path.lexists(target) and not _same_name(source, target):
        if copy and os.path.isfile(target) and filecmp.cmp(source, target, shallow=False):
            return
        if not overwrite or (os.path.exists(target) and os.path.samefile(source, target)):
            raise PlanError(f"{target!r} is there already; {source!r} was left")
    try:
        if not copy:
            try:
                os.rename(source, target)
                return
            except OSError as e:
                if e.errno != 18:  # EXDEV: another file system
                    raise
        part = f"{folder}/.part-{uuid.uuid4().hex}"
        try:
            shutil.copyfile(source, part) if copy else shutil.copy2(source, part)
            os.rename(part, target)
        finally:
            if os.path.lexists(part):
                os.unlink(part)
        if not copy:
            os.unlink(source)
    except OSError as e:
        raise PlanError(f"{source!r} to {target!r}: {e}") from e


def _again(source: str, target: str, copy: bool, overwrite: bool) -> None:
    """A step that was started and may have been done, in part or whole."""
    if os.path.isfile(target) and os.path.isfile(source) and not os.path.samefile(source, target) and not overwrite:
        if not filecmp.cmp(source, target, shallow=False):
            raise PlanError(f"{target!r} is there already; {source!r} was left")
        if not copy:
            os.unlink(source)
        return
    transfer(source, target, copy, overwrite)


def carried_out(rows: Iterable[tuple], log: Log, overwrite: bool = False, retry_failed: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(source_path, step_source, step_target, action, refused) to (source_path, step_target, failure), each done at most once.

    What failed by the log has failed, unless it is to be tried again. What can't leave its passing name goes back to its own, if that is free.
    """
    for key, source, target, action, refused in rows:
        state, why = log.states.get(key, (None, None))
        if refused or state == "done" or (state == "failed" and not retry_failed):
            yield key, target, refused or why
            continue
        try:
            if state == "started":
                _again(source, target, action == "copy", overwrite)
            else:
                if action != "copy" and not overwrite and os.path.lexists(source) and os.path.lexists(target) and source != target and not _same_name(source, target):
                    raise PlanError(f"{target!r} is there already; {source!r} was left")
                log.write(key, "started")
                transfer(source, target, action == "copy", overwrite)
            log.write(key, "done")
            yield key, target, None
        except (PlanError, OSError) as e:
            if log.wave == WAVES[-1] and os.path.lexists(source) and not os.path.lexists(key):
                os.rename(source, key)
            log.write(key, "failed", str(e))
            yield key, target, str(e)


def run_on_executors(plan: DataFrame | None, folder: str, overwrite: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """Carries a journal's plan out, wave by wave, and returns source_path, target_path and failure (null when done) of every row but the skipped ones.

    Started again, it goes on from the journal alone: ``plan`` is only asked for if the journal has none.
    """
    written = write_plan(plan, folder, spark)
    spark, every = written.sparkSession, steps(written, folder, overwrite)

    schema = pa.schema([("source_path", pa.string()), ("target_path", pa.string()), ("wave", pa.int32()), ("failure", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, task = None, None
        for batch in batches:
            out = []
            for wave, own, key, source, target, final, action, refused in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != task:
                    if log is not None:
                        log.close()
                    log, task = Log(folder, wave, str(own), uuid.uuid4().hex), own
                out += [(key, final, wave, failure) for key, _, failure in carried_out([(key, source, target, action, refused)], log, overwrite)]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)
        if log is not None:
            log.close()

    found = None
    for wave in WAVES:
        own = every.where(F.col("wave") == wave)
        ordered = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "depth", "chain")
        columns = ["wave", "task", "source_path", "step_source", "step_target", "target_path", "action", "refused"]
        done = _table(spark, folder, f"outcome/{wave}", lambda rows=ordered, columns=columns: rows.select(*columns).mapInArrow(run, DONE))
        found = done if found is None else found.unionByName(done)
    return found.groupBy("source_path", "target_path").agg(F.max_by("failure", F.when(F.col("failure").isNotNull(), F.col("wave") + 3).otherwise(F.col("wave"))).alias("failure"))

"""The journal: a run that is killed anywhere and started again ends as an unbroken one; moves that wait for one another."""

import multiprocessing
import os
import random
import shutil
import signal

import pytest
from pyspark.sql import functions as F
from test_filesystem import read, tree, write

from filewright.operators import journal as J
from filewright.operators import sink, staging
from filewright.operators.sink import PlanError, apply_on_executors, apply_plan
from filewright.plans import commands
from filewright.plans.options import RenameOptions

PLAN = "source_path string, target_path string, group_key string, idx int, dup_no int, is_duplicate boolean, action string"


class Killed(BaseException):
    pass


def plan_of(spark, moves, action="move"):
    return spark.createDataFrame([(a, b, "g", i, None, False, action) for i, (a, b) in enumerate(moves)], PLAN)


def contents(root):
    return {name: read(f"{root}/{name}") for name in tree(root)}


def test_the_plan_is_what_was_carried_out(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, {"X.JPG": b"1", "x.jpg": b"2", "Y.JPG": b"3"})
    plan, outcome = commands.lower(RenameOptions(root, dry_run=False)).run(spark, str(tmp_path / "journal"))
    moved = {os.path.basename(r.source_path): os.path.basename(r.target_path) for r in plan.collect()}
    assert outcome.done == 2 and moved == {"X.JPG": "x-duplicate-001.jpg", "Y.JPG": "y.jpg"} and tree(root) == {"x.jpg", "x-duplicate-001.jpg", "y.jpg"}
    again, outcome = commands.lower(RenameOptions(root, dry_run=False)).run(spark, str(tmp_path / "journal"))
    assert again.collect() == plan.collect() and outcome.done == 2 and tree(root) == {"x.jpg", "x-duplicate-001.jpg", "y.jpg"}


def test_a_run_leaves_only_its_journal(spark, tmp_path, monkeypatch):
    """Tables that planning writes go when the plan is written."""
    root, made = str(tmp_path / "in"), []

    def folder(spark, label):
        made.append(f"{tmp_path}/shared/{label}-{len(made)}")
        return f"file://{made[-1]}"

    monkeypatch.setattr(staging, "shared_folder", folder)
    write(root, {"a/x.j": b"same", "b/y.j": b"same", "c/z-duplicate-001.j": b"other"})
    plan, outcome = commands.content_hash(RenameOptions(root, dry_run=False)).run(spark, str(tmp_path / "journal"))
    assert outcome.done == plan.count() > 0 and len(made) > 2 and not os.listdir(tmp_path / "shared")


FILES = {"a/X.J": b"1", "a/x.j": b"2", "b/Y.J": b"3", "b/Z.J": b"4", "W.J": b"5", "b/w.J": b"6"}


@pytest.mark.parametrize("copy", [False, True])
@pytest.mark.parametrize("executors", [False, True])
def test_killed_between_any_two_files(spark, tmp_path, monkeypatch, copy, executors):
    """Killed before or after each transfer, and before the log has it, then started again from the journal alone."""
    def options(k):
        return RenameOptions(f"{tmp_path}/{k}", f"{tmp_path}/{k}-out" if copy else None, copy=copy, dry_run=False)

    def state(k):
        return contents(f"{tmp_path}/{k}"), contents(f"{tmp_path}/{k}-out") if copy else None

    write(tmp_path / "whole", FILES)
    commands.lower(options("whole")).run(spark, f"{tmp_path}/whole-journal")
    own = J.transfer
    for at in (0, 2) if copy or executors else range(6):
        for after in (False, True):
            k = f"{at}{after}"
            write(tmp_path / k, FILES)
            if executors:  # a task that is lost: its plan and steps are there, and some of its files are moved
                plan = J.write_plan(commands.lower(options(k)).plan(commands.lower(options(k)).scan(spark)), f"{tmp_path}/{k}-journal")
                rows = J.steps(plan, f"{tmp_path}/{k}-journal").orderBy("source_path").collect()
                for i, r in enumerate(rows[: at + 1]):
                    log = J.Log(f"{tmp_path}/{k}-journal", 1, str(r.task), "lost")
                    log.write(r.source_path, "started")
                    if i < at or after:
                        own(r.step_source, r.step_target, copy)
                    if i < at:
                        log.write(r.source_path, "done")
                    log.close()
            else:
                count = [0]

                def dying(*args, count=count, at=at, after=after):
                    count[0] += 1
                    if count[0] == at + 1:
                        if after:
                            own(*args)
                        raise Killed
                    own(*args)

                monkeypatch.setattr(J, "transfer", dying)
                try:
                    commands.lower(options(k)).run(spark, f"{tmp_path}/{k}-journal")
                except Killed:
                    pass
                monkeypatch.setattr(J, "transfer", own)
            monkeypatch.setattr(commands.RenameQuery, "scan", None)  # no second scan, no second plan
            commands.lower(options(k)).run(spark, f"{tmp_path}/{k}-journal", on_executors=executors)
            monkeypatch.undo()
            assert state(k) == state("whole"), k


def _work(folder, rows, die_at):
    count = [0]
    own = J.transfer

    def dying(*args):
        own(*args)
        count[0] += 1
        if count[0] == die_at:
            os.kill(os.getpid(), signal.SIGKILL)

    J.transfer = dying
    log = J.Log(folder, 1, "t", f"{os.getpid()}")
    list(J.carried_out(rows, log))
    os._exit(0)


def test_a_killed_process(tmp_path):
    """A worker process is killed outright again and again; each new one goes on from the log."""
    files = {f"f{i:02}": str(i).encode() for i in range(20)}
    write(tmp_path / "in", files)
    rows = [(f"{tmp_path}/in/{n}", f"{tmp_path}/in/{n}", f"{tmp_path}/out/{n}.x", "move", None) for n in files]
    context = multiprocessing.get_context("fork")
    for die_at in (3, 1, 7, 1, 1, 100):
        p = context.Process(target=_work, args=(str(tmp_path / "journal"), rows, die_at))
        p.start()
        p.join()
    assert contents(tmp_path / "out") == {f"{n}.x": x for n, x in files.items()} and not tree(tmp_path / "in")
    log = J.Log(str(tmp_path / "journal"), 1, "t", "last")
    assert {s for s, _ in log.states.values()} == {"done"} and len(log.states) == 20


def test_a_torn_line_and_a_copy_across_file_systems(tmp_path):
    write(tmp_path, {"a": b"1", "b": b"1", "c": b"2"})
    os.makedirs(tmp_path / "j/log/t")
    (tmp_path / "j/log/t/1-x.log").write_text('{"at": "%s", "wave": 1, "state": "started"}\n{"at": "zz", "wa' % (tmp_path / "a"))
    log = J.Log(str(tmp_path / "j"), 1, "t", "y")
    assert list(log.states) == [str(tmp_path / "a")]
    # started, its bytes are at the target whole, and the source is still there: it goes
    assert list(J.carried_out([(str(tmp_path / "a"), str(tmp_path / "a"), str(tmp_path / "b"), "move", None)], log)) == [(str(tmp_path / "a"), str(tmp_path / "b"), None)]
    assert tree(tmp_path) >= {"b", "c"} and "a" not in tree(tmp_path)
    (done,) = J.carried_out([(str(tmp_path / "c"), str(tmp_path / "c"), str(tmp_path / "b"), "move", None)], log)
    assert "there already" in done[2] and read(tmp_path / "c") == b"2"


@pytest.mark.parametrize("executors", [False, True])
@pytest.mark.parametrize("segment", [2, 1000])
def test_chains_and_cycles(spark, tmp_path, monkeypatch, executors, segment):
    monkeypatch.setattr(J, "SEGMENT", segment)
    root = str(tmp_path / "in")
    names = [f"n{i:02}" for i in range(30)]
    random.Random(3).shuffle(names)
    moves = [(names[i], names[i + 1]) for i in range(8)]  # a chain of eight; names[8] is free
    moves += [(names[9], names[10]), (names[10], names[9])]  # a swap
    moves += [(names[11 + i], names[11 + (i + 1) % 7]) for i in range(7)]  # a cycle of seven
    moves += [(names[18], names[19]), (names[20], names[20])]  # alone, and where it is
    random.Random(4).shuffle(moves)
    write(root, {a: a.encode() for a, _ in moves})
    plan = plan_of(spark, [(f"{root}/{a}", f"{root}/d/../{b}".replace("d/../", "")) for a, b in moves])
    if executors:
        failures = [r.failure for r in apply_on_executors(plan, journal=str(tmp_path / "journal")).collect()]
        assert failures == [None] * len(moves)
    else:
        assert apply_plan(plan, journal=str(tmp_path / "journal")).done == len(moves)
    assert contents(root) == {b: a.encode() for a, b in moves}


def test_a_chain_that_is_blocked_loses_nothing(spark, tmp_path):
    """The end of a cycle's way is refused by a file that isn't in the plan: what can't move stays or goes back."""
    root = str(tmp_path)
    write(root, {"a": b"1", "b": b"2", "c": b"3"})
    shutil.os.makedirs(f"{root}/d")
    plan = plan_of(spark, [(f"{root}/a", f"{root}/b"), (f"{root}/b", f"{root}/c")])  # c stays
    got = {r.source_path[-1]: r.failure for r in apply_on_executors(plan, journal=str(tmp_path / "j")).collect()}
    assert got["a"] and got["b"] and {n: read(f"{root}/{n}") for n in "abc"} == {"a": b"1", "b": b"2", "c": b"3"}
    gone = plan_of(spark, [(f"{root}/a", f"{root}/b"), (f"{root}/b", f"{root}/a"), (f"{root}/none", f"{root}/x")])
    outcome = apply_plan(gone, on_error="continue", journal=str(tmp_path / "k"))
    assert outcome.done == 2 and len(outcome.failed) == 1 and read(f"{root}/a") == b"2"


def test_a_long_chain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "SEGMENT", 100)
    root, n = str(tmp_path / "in"), 3000
    os.makedirs(root)
    for i in range(n):
        with open(f"{root}/{i}", "w") as f:
            f.write(str(i))
    plan = spark.range(n).selectExpr(f"concat('{root}/', id) source_path", f"concat('{root}/', id + 1) target_path", "'g' group_key", "0 idx", "null dup_no", "false is_duplicate", "'move' action")
    done = apply_on_executors(plan, journal=str(tmp_path / "journal"))
    assert done.where("failure is null").count() == n
    assert all(read(f"{root}/{i + 1}") == str(i).encode() for i in range(0, n, 97)) and len(os.listdir(root)) == n
    every = spark.read.parquet(f"file://{tmp_path}/journal/steps")
    assert every.where("wave = 1").groupBy("chain").count().agg(F.max("count")).first()[0] <= 100


def test_abort_and_retry(spark, tmp_path):
    root, folder = str(tmp_path / "in"), str(tmp_path / "journal")
    write(root, {"a": b"1", "b": b"2", "x": b"old"})
    plan = plan_of(spark, [(f"{root}/a", f"{root}/x"), (f"{root}/b", f"{root}/y")])
    with pytest.raises(PlanError):
        apply_plan(plan, journal=folder)
    os.unlink(f"{root}/x")
    with pytest.raises(PlanError):
        apply_plan(plan, journal=folder)
    assert apply_plan(plan, journal=folder, retry_failed=True).done == 2 and contents(root) == {"x": b"1", "y": b"2"}


def test_links_are_not_taken_for_one_name(tmp_path):
    write(tmp_path, {"real": b"1"})
    os.symlink(f"{tmp_path}/real", f"{tmp_path}/soft")
    os.link(f"{tmp_path}/real", f"{tmp_path}/hard")
    for source in ("soft", "hard"):
        for overwrite in (False, True):
            with pytest.raises(PlanError):
                sink.transfer(f"{tmp_path}/{source}", f"{tmp_path}/real", overwrite=overwrite)
    assert read(f"{tmp_path}/real") == b"1"

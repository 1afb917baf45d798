import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import StringStartsWith

from filewright.__main__ import main
from filewright.operators.sink import PlanError, apply_on_executors, apply_plan, transfer
from filewright.plans import commands
from filewright.plans.options import RenameOptions
from filewright.sources import content, inventory
from filewright.sources.content import with_read
from filewright.sources.exif import capture_fields, exif
from filewright.sources.inventory import scan


def write(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names}


def image(date, sub=None, order="<"):
    """A TIFF directory in a JPEG."""
    fields = [(0x9003, date.encode() + b"\0")] + ([(0x9291, sub.encode() + b"\0")] if sub is not None else [])
    at = 8 + 2 + 12 + 4 + 2 + 12 * len(fields) + 4
    entries, tail = b"", b""
    for tag, value in fields:
        inline = len(value) <= 4
        entries += struct.pack(order + "HHI", tag, 2, len(value)) + (value.ljust(4, b"\0") if inline else struct.pack(order + "I", at + len(tail)))
        tail += b"" if inline else value
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    tiff += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, 26) + struct.pack(order + "I", 0)
    tiff += struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + tail
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_fields(order):
    assert capture_fields(image("2024:01:20 12:10:05", "555", order)) == ("2024:01:20 12:10:05", "555")
    assert capture_fields(image("2024:01:20 12:10:05", "123456", order)) == ("2024:01:20 12:10:05", "123456")
    assert capture_fields(image("2024:01:20 12:10:05", None, order)[12:-2]) == ("2024:01:20 12:10:05", None)
    for bad in (None, b"", b"text", b"\xff\xd8\xff\xe1\x00\x10Exif\0\0II*\0"):
        assert capture_fields(bad) == (None, None)


def test_scan(spark, tmp_path):
    write(tmp_path, {"a.txt": b"1", ".hidden": b"2", ".dir/x": b"3", "_d/y.txt": b"4", "d/e/z.TXT": b"5"})
    os.symlink(f"{tmp_path}/d", f"{tmp_path}/link")
    os.symlink("nowhere", f"{tmp_path}/broken")
    got = {os.path.relpath(r.path, tmp_path): (r.is_file, r.length) for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (True, 1), ".hidden": (True, 1), ".dir/x": (True, 1), "_d/y.txt": (True, 1), "d/e/z.TXT": (True, 1), "link": (False, None), "broken": (False, None)}
    got = {os.path.basename(r.path): bytes(r.content) for r in scan(spark, str(tmp_path), content=True).where("is_file").collect()}
    assert got == {"a.txt": b"1", ".hidden": b"2", "x": b"3", "y.txt": b"4", "z.TXT": b"5"}


def test_deep_trees_are_read_by_several_tasks(spark, tmp_path):
    write(tmp_path, {f"only/one/d{i}/e{k}/f.txt": b"x" for i in range(6) for k in range(3)})
    found = scan(spark, str(tmp_path))
    assert found.count() == 18 and found.rdd.getNumPartitions() > 10


def test_bytes_are_read_where_the_files_are(spark, tmp_path, monkeypatch):
    write(tmp_path, {"a.jpg": image("2024:01:20 12:10:05", "555"), "b.tif": image("2024:01:20 12:10:05")[12:-2], "c.txt": b"", "d.txt": b"x" * 100})
    os.symlink("nowhere", f"{tmp_path}/broken")
    hashes = {os.path.basename(r.path): r.content_hash for r in with_read(scan(spark, str(tmp_path)), "content_hash").collect()}
    assert hashes["d.txt"] == hashlib.sha256(b"x" * 100).hexdigest() and hashes["broken"] is None and len(hashes) == 5
    fields = {os.path.basename(r.path): tuple(r.exif) for r in with_read(scan(spark, str(tmp_path)), "exif").collect()}
    assert fields == {"a.jpg": ("2024:01:20 12:10:05", "555"), "b.tif": ("2024:01:20 12:10:05", None), "c.txt": (None, None), "d.txt": (None, None), "broken": (None, None)}


def parts(root, *filters):
    reader = inventory._Reader({"path": str(root)})
    assert list(reader.pushFilters(list(filters))) == [f for f in filters if not isinstance(f, StringStartsWith)]
    return reader, reader.partitions()


def test_any_tree_gives_few_parts(spark, tmp_path, monkeypatch):
    """A root of very many sub-directories, and one flat directory of very many files, are divided evenly; nothing is listed twice or left out."""
    monkeypatch.setattr(inventory, "LOOKED_AT", 50)
    write(tmp_path, {f"many/d{i}/f": b"x" for i in range(300)} | {f"flat/f{i}": b"x" for i in range(400)} | {"few/a/b/c": b"x", "top": b"x"})
    reader, found = parts(tmp_path)
    assert len(found) <= inventory.SUBTREES
    rows = [[r[0] for r in reader.read(p)] for p in found]
    every = sorted(x for r in rows for x in r)
    assert every == sorted(os.path.join(d, n) for d, _, names in os.walk(tmp_path) for n in names)
    assert max(map(len, rows)) < 3 * len(every) / len(found) + 10


def test_pushed_conditions_prune(spark, tmp_path, monkeypatch):
    """Subtrees that can't match are never listed, and the rows are the same."""
    write(tmp_path, {f"{d}/{e}/f{i}": b"x" for d in "abc" for e in "xy" for i in range(3)})
    seen, own = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda d: (seen.append(os.path.relpath(d, tmp_path)), own(d))[1])
    reader, found = parts(tmp_path, StringStartsWith(("path",), f"{tmp_path}/a/x/f"))
    assert len([r for p in found for r in reader.read(p)]) == 3 and not {"b", "c", "a/y"} & set(seen)
    monkeypatch.undo()
    df = scan(spark, str(tmp_path))
    assert df.where(F.col("path").startswith(f"{tmp_path}/b/") & F.col("is_file")).count() == 6
    assert df.where(F.col("path") == f"{tmp_path}/c/x/f1").count() == 1 and df.where(F.col("path").isin(f"{tmp_path}/c/x/f1", f"{tmp_path}/none")).count() == 1
    assert df.where(~F.col("is_file")).count() == 0 and df.where(F.col("path").endswith("f1")).count() == 6
    assert df.where(F.col("path").startswith("/nowhere")).count() == 0


def test_only_target_directories_are_listed(spark, tmp_path):
    """A target tree's other directories aren't listed; plans are as with all of it."""
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"a/X.j": b"1", "a/b/Y.j": b"2", "n.j": b"3"})
    write(out, {"a/x.j": b"old", "a/x-duplicate-001.j": b"old", "other/z.j": b"z", "a/c/deep.j": b"z"} | {f"more/f{i}": b"" for i in range(50)})
    command = commands.lower(RenameOptions(root, out))
    files = command.scan(spark)
    there = {os.path.relpath(r.path, out) for r in command.on_disk(files).collect()}
    assert there == {"a/x.j", "a/x-duplicate-001.j"}
    show = lambda plan: sorted((r.source_path, r.target_path, r.idx, r.dup_no) for r in plan.collect())
    assert show(command.plan(files)) == show(command.plan(files, scan(spark, out).select("path")))
    assert commands.lower(RenameOptions(root, f"{out}/none")).on_disk(files) is None


@pytest.mark.parametrize("edge", [4, 1 << 16])
def test_contents_in_tiers(spark, tmp_path, monkeypatch, edge):
    """The same groups as by whole hashes; files with a size of their own, and empty ones, aren't opened, and only files with equal edges are read whole."""
    monkeypatch.setattr(content, "EDGE", edge)
    long_ = b"head" + b"x" * 40 + b"tail"
    files = {"a": b"", "d/b": b"", "alone": b"1234567", "c": b"abc", "d/d": b"abc", "e": b"xyz", "f": long_, "g": long_, "h": b"head" + b"y" * 40 + b"tail", "i": b"HEAD" + b"x" * 40 + b"tail", "j": b"head" + b"x" * 40 + b"TAIL"}
    write(tmp_path, files)
    os.symlink("nowhere", f"{tmp_path}/broken")
    rows = {os.path.relpath(r.path, tmp_path): r for r in content.content_tiers(scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {*files, "broken"} and rows["broken"].content_hash is None
    for a in files:
        for b in files:
            assert (files[a] == files[b]) == (rows[a].content_hash == rows[b].content_hash), (a, b)
    assert [rows[n].tier for n in ("a", "d/b", "alone")] == [0, 0, 0] and [rows[n].tier for n in "cefghij"] == ([1, 1, 2, 2, 2, 1, 1] if edge == 4 else [1] * 7)
    command = commands.content_hash(RenameOptions(str(tmp_path)))
    whole = commands.content_hash(RenameOptions(str(tmp_path))).plan(scan(spark, str(tmp_path), content=True))
    show = lambda plan: sorted((r.source_path, r.target_path, r.idx, r.dup_no) for r in plan.collect())
    assert show(command.plan(command.scan(spark))) == show(whole)


def test_files_of_their_own_size_are_not_opened(spark, tmp_path):
    write(tmp_path, {"alone": b"1234567", "x": b"abc", "y": b"abd", "control": b"control bytes"})
    for n in ("alone", "x", "y", "control"):
        os.utime(f"{tmp_path}/{n}", (1, 10**9))
    read(f"{tmp_path}/control")
    if os.stat(f"{tmp_path}/control").st_atime == 1:
        pytest.skip("this file system keeps no times of access")
    content.content_tiers(scan(spark, str(tmp_path))).collect()
    assert os.stat(f"{tmp_path}/alone").st_atime == 1 and os.stat(f"{tmp_path}/x").st_atime > 1


def read(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.mark.parametrize("copy", [True, False])
def test_files_in_the_target_keep_their_bytes(spark, tmp_path, copy):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"a/x.j": b"new", "a/y.j": b"other"})
    write(out, {"a/x.j": b"precious old"})
    apply_plan(commands.content_hash(RenameOptions(root, out, copy=copy)).plan(scan(spark, root, content=True)))
    assert tree(out) == {"a/x.j", "a/x-duplicate-001.j", "a/y.j"}
    assert read(f"{out}/a/x.j") == b"precious old" and read(f"{out}/a/x-duplicate-001.j") == b"new"


def test_transfer_refuses_a_target_that_is_there(tmp_path):
    write(tmp_path, {"a": b"new", "b": b"old", "same": b"new"})
    a, b, same = (str(tmp_path / n) for n in ("a", "b", "same"))
    for copy in (True, False):
        with pytest.raises(PlanError):
            transfer(a, b, copy)
    assert read(b) == b"old" and read(a) == b"new"
    transfer(a, same, copy=True)  # copied already
    transfer(a, b, overwrite=True)
    assert read(b) == b"new" and not os.path.exists(a)


def test_numbers_that_are_not_checked_do_not_overwrite(spark, tmp_path):
    """A second file's number isn't looked up on disk (Q7): the plan names a file that is there, and the sink refuses."""
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"a/x.j": b"same", "a/y.j": b"same"})
    write(out, {"a/x-duplicate-001.j": b"precious"})
    plan = commands.content_hash(RenameOptions(root, out, copy=True)).plan(scan(spark, root, content=True))
    outcome = apply_plan(plan, on_error="continue")
    assert outcome.done == 1 and len(outcome.failed) == 1 and read(f"{out}/a/x-duplicate-001.j") == b"precious"


def test_executors_carry_out_a_plan(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {f"d{i}/x{i}.j": str(i % 7).encode() for i in range(20)})
    plan = commands.lower(RenameOptions(root, out, copy=True)).plan(scan(spark, root))
    for _ in range(2):  # again: done already
        assert [r.failure for r in apply_on_executors(plan).collect()] == [None] * 20
    assert len(tree(out)) == 20
    clash = plan.withColumn("target_path", F.lit(f"{out}/one"))
    assert all(r.failure for r in apply_on_executors(clash).collect())


def test_command_line(spark, tmp_path, capsys):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"A.JPEG": b"1", "b.jpeg": b"2", "18-12-31 22-15-00.jpg": b"3"})
    assert main(["rename:pattern", root, out, "--copy", "--dry-run"], spark) == 0
    assert not os.path.exists(out) and "b.jpg" in capsys.readouterr().out
    assert main(["rename:pattern", root, out, "-c"], spark) == 0 and tree(out) == {"b.jpg"}
    assert main(["rename:date-pattern", root, out, "-c"], spark) == 0 and tree(out) == {"b.jpg", "2018-12-31_22-15-00.jpg"}
    assert main(["rename:lower", root], spark) == 0 and tree(root) == {"a.jpeg", "b.jpeg", "18-12-31 22-15-00.jpg"}
    assert main(["rename:hash", root, "--copy"], spark) == 1 and main(["rename:pattern", root, out, "-p", "bad"], spark) == 1


def test_dry_run_move_and_copy(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"a/x.j": b"same", "a/y.j": b"same", "b/z.j": b"other"})
    plan = commands.content_hash(RenameOptions(root, out, copy=True)).plan(scan(spark, root, content=True))
    assert plan.count() == 3 and not os.path.exists(out)
    assert apply_plan(plan).done == 3
    assert tree(out) == {"a/x.j", "a/x-duplicate-001.j", "b/z.j"} and len(tree(root)) == 3
    plan = commands.content_hash(RenameOptions(root)).plan(scan(spark, root, content=True)).cache()
    assert apply_plan(plan).done == 1 and apply_plan(plan).done == 1  # again: done already
    assert tree(root) == {"a/x.j", "a/x-duplicate-001.j", "b/z.j"}
    plan.unpersist()


def test_skip_and_failures(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"x.j": b"same", "y.j": b"same"})
    outcome = apply_plan(commands.content_hash(RenameOptions(root, out, copy=True, skip_duplicates=True)).plan(scan(spark, root, content=True)))
    assert (outcome.done, outcome.skipped) == (1, 1) and tree(out) == {"x.j"}
    gone = spark.createDataFrame([("/none/a", f"{out}/a", "g", 0, None, False, "move")], "source_path string, target_path string, group_key string, idx int, dup_no int, is_duplicate boolean, action string")
    with pytest.raises(PlanError):
        apply_plan(gone)
    assert len(apply_plan(gone, on_error="continue").failed) == 1
    both = gone.unionByName(gone.withColumn("group_key", F.lit("h")))
    assert all("several" in x[2] for x in apply_plan(both, on_error="continue").failed)


def test_exif_command(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a/I.JPG": image("2024:01:20 12:10:05", "555"), "a/I.MOV": b"video", "a/J.JPG": image("2024:01:20 12:10:05", "555"), "a/K.JPG": b"none"})
    inventory = scan(spark, root, content=True).select("path", exif("content").alias("exif"))
    apply_plan(commands.exif_date(RenameOptions(root)).plan(inventory))
    name = "2024-01-20_12-10-05-555"
    assert tree(root) == {f"a/{name}.JPG", f"a/{name}.MOV", f"a/{name}-duplicate-001.JPG", "a/K.JPG"}

import dataclasses
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from model import rename, split

from filewright.functions.names import decomposed
from filewright.operators.collection import sliced
from filewright.operators import plan as plans
from filewright.plans import commands
from filewright.plans.options import RenameOptions
from filewright.sources.inventory import scan_order


def inventory(spark, files):
    return spark.createDataFrame(files, "path string, content string")


def planned(df):
    return {r.source_path: (r.target_path, r.idx, r.dup_no) for r in df.collect()}


def strip(name):
    stem, ext = split(name)
    return re.sub("-duplicate-[0-9]{3}$", "", stem) + "." + ext


def paths(files):
    return {p for p, _ in files}


@pytest.mark.parametrize("files, expected", [
    (["a/x.j", "a/y.j"], {"a/y.j": "a/x-duplicate-001.j"}),
    (["a/x.j", "b/y.j"], {"b/y.j": "b/x.j"}),
    (["a/x.j", "b/x.j"], {"b/x.j": "b/x-duplicate-001.j"}),
    (["a/x.j", "a/x-duplicate-001.j"], {"a/x.j": "a/x-duplicate-002.j"}),
])
def test_hash_cases(spark, files, expected):
    df = inventory(spark, [("/r/" + f, "same") for f in files])
    got = {k: v[0] for k, v in planned(commands.content_hash(RenameOptions("/r")).plan(df)).items()}
    if files == ["a/x.j", "a/x-duplicate-001.j"]:  # by path the marked file comes first, and both targets are the plain name
        assert got == {"/r/a/x-duplicate-001.j": "/r/a/x-duplicate-002.j"}
    else:
        assert got == {"/r/" + k: "/r/" + v for k, v in expected.items()}


def test_lower_cases(spark):
    df = inventory(spark, [("/r/A.JPG", ""), ("/r/a.jpg", ""), ("/r/README", ""), ("/r/.Hidden", "")])
    got = {k: v[0] for k, v in planned(commands.lower(RenameOptions("/r")).plan(df)).items()}
    assert got == {"/r/A.JPG": "/r/a-duplicate-001.jpg", "/r/README": "/r/readme.", "/r/.Hidden": "/r/.hidden.hidden"}


def test_documented_examples(spark):
    o = RenameOptions("/r", "/t")
    df = inventory(spark, [("/r/x.jpeg", ""), ("/r/y.png", "")])
    assert planned(commands.pattern(o).plan(df)) == {"/r/x.jpeg": ("/t/x.jpg", 0, None)}
    df = inventory(spark, [("/r/18-12-31 22-15-00.jpg", ""), ("/r/23-02-31 25-61-00.jpg", ""), ("/r/other.jpg", "")])
    assert {k: v[0] for k, v in planned(commands.date(o).plan(df)).items()} == {"/r/18-12-31 22-15-00.jpg": "/t/2018-12-31_22-15-00.jpg", "/r/23-02-31 25-61-00.jpg": "/t/2023-03-04_02-01-00.jpg"}


@pytest.mark.parametrize("name, pattern, replacement, expected", [
    ("20-01-02,21-03-04", "/{y}-{m}-{d}/", "{Y}{m}{d}", "2020010202,2021030404."),  # without a group of its own the last part comes again
    ("20-01-02,21-03-04.j", r"/{y}-{m}-{d}(,?)/", "{Y}{m}{d}", "20200102,20210304.j"),
    ("20-01-02x.j", r"/{y}-{m}-{d}(x)(y)?/", "{Y}", "2020x.j"),
    ("20-01-02xy.j", r"/{y}-{m}-{d}(x)(y)?/", "{Y}", "2020y.j"),
    ("none.j", "/{y}-{m}-{d}/", "{Y}", None),
])
def test_every_match_of_a_date_pattern(spark, name, pattern, replacement, expected):
    df = inventory(spark, [("/r/" + name, "")])
    got = {k: v[0] for k, v in planned(commands.date(RenameOptions("/r", "/t"), pattern, replacement).plan(df)).items()}
    assert got == ({"/r/" + name: "/t/" + expected} if expected else {})


@pytest.mark.parametrize("name, stem, ext, directory", [("/a/b.c", "b", "c", "/a"), ("/a/.b", ".b", "b", "/a"), ("/a/b", "b", "", "/a"), ("/a/b.", "b", "", "/a"), ("/a/", "", "", "/a"), ("b.c.d", "b.c", "d", ""), ("/a/..", ".", "", "/a"), ("/a/.", ".", "", "/a")])
def test_name_parts(spark, name, stem, ext, directory):
    row = decomposed(inventory(spark, [(name, "")])).first()
    assert (row.stem, row.ext, row.dir) == (stem, ext, directory) and split(row.filename) == (stem, ext)


def test_companions_of_several_groups_and_none(spark):
    date = lambda s: (f"2024:01:20 12:10:0{s}", None)
    rows = [("/r/a/I.JPG", date(1)), ("/r/a/I.HEIC", date(2)), ("/r/a/I.mov", None), ("/r/a/alone.mov", None), ("/r/b/K.JPG", date(2)), ("/r/b/K", None)]
    df = spark.createDataFrame(rows, "path string, exif struct<date_time_original:string,sub_sec_time_original:string>")
    got = {k: v[0] for k, v in planned(commands.exif_date(RenameOptions("/r")).plan(df)).items()}
    name = "2024-01-20_12-10-0"
    assert got == {
        "/r/a/I.HEIC": f"/r/a/{name}2-000.HEIC", "/r/a/I.JPG": f"/r/a/{name}1-000.JPG", "/r/b/K.JPG": f"/r/b/{name}2-000.JPG",
        "/r/a/I.mov": f"/r/a/{name}2-000.mov", "/r/b/K": f"/r/b/{name}2-000.",
    }


def test_ordered_results(spark):
    """The sort and the scan order give rows in order."""
    df = inventory(spark, [(f"/r/{n}", "") for n in ("b", "a", "c/a", "B", "é")])
    assert [r.path for r in scan_order(df).collect()] == ["/r/B", "/r/a", "/r/b", "/r/c/a", "/r/é"]
    assert [r.path for r in sliced(df, ["path"], -2).collect()] == ["/r/c/a", "/r/é"]
    assert [r.path for r in sliced(df, ["path"], 1, -2).collect()] == ["/r/a", "/r/b"]


def test_plans_read_once(spark):
    """One scan and one pass of the pattern for dates; one scan for companions."""
    df = inventory(spark, [("/r/20-01-02 10-11-12.j", "")])
    plan = lambda q, df: q.plan(df)._jdf.queryExecution().executedPlan().toString()
    text = plan(commands.date(RenameOptions("/r", "/t")), df)
    assert text.count(r"^(\d{2})-(\d{2})-(\d{2})") <= 2  # the filter of raw names, and the replacement
    exif = spark.createDataFrame([("/r/a.j", ("2024:01:20 12:10:05", None))], "path string, exif struct<date_time_original:string,sub_sec_time_original:string>")
    assert plan(commands.exif_date(RenameOptions("/r", "/t")), exif).count("Scan ExistingRDD") <= 1


@pytest.mark.parametrize("q, files, target, expected", [
    ("Q6", ["a/ba/a/x.j"], "t", {"a/ba/a/x.j": "t/b/x.j"}),
    ("Q10", ["20-01-02.j"], "{Y}_d", {"20-01-02.j": "2020_02.j"}),
    ("Q11", ["20-01-02.j"], "{Y}", {"20-01-02.j": "2020.j"}),
    ("Q13", ["20-01-02-duplicate-001.j"], "{Y}", {"20-01-02-duplicate-001.j": "2020.j"}),
])
def test_quirks(spark, q, files, target, expected):
    df = inventory(spark, [(f, "x") for f in files])
    if q == "Q6":  # the source root's text goes wherever it stands
        command = commands.content_hash(RenameOptions("a", "t"))
    elif q == "Q13":  # the filter sees the marked name, the replacement the plain one
        command = commands.date(RenameOptions("", "/"), "/^{y}-{m}-{d}(-duplicate-001)?(\\.j)$/", target)
    else:
        command = commands.date(RenameOptions("", "/"), "/^{y}-{m}-{d}(\\.j)$/", target)
    got = {k: v[0].lstrip("/") for k, v in planned(command.plan(df)).items()}
    assert got == expected


@pytest.mark.parametrize("sub, expected", [("555", "12-10-05-555"), ("1234", "12-10-06-234"), ("123456", "12-10-05-123"), ("", "12-10-05-000"), (None, "12-10-05-000"), ("5", "12-10-05-005")])
def test_capture_time(spark, sub, expected):
    rows = [("/r/a/I.JPG", ("2024:01:20 12:10:05", sub)), ("/r/a/I.mov", None), ("/r/b/I.mov", None), ("/r/a/bad.JPG", ("0000:00:00 00:00:00", None))]
    df = spark.createDataFrame(rows, "path string, exif struct<date_time_original:string,sub_sec_time_original:string>")
    got = {k: v[0] for k, v in planned(commands.exif_date(RenameOptions("/r")).plan(df)).items()}
    assert got == {"/r/a/I.JPG": f"/r/a/2024-01-20_{expected}.JPG", "/r/a/I.mov": f"/r/a/2024-01-20_{expected}.mov"}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("target", ["/r", "/t"])
def test_random_trees(spark, seed, target):
    rng = random.Random(seed)
    files = {}
    for _ in range(120):
        name = rng.choice("abcAB") + rng.choice(["", "", "-duplicate-00" + rng.choice("123")]) + rng.choice([".j", ".J", "", ".k"])
        files[f"/r/{rng.choice(['d', 'd/e', 'f'])}/{name}"] = rng.choice("uvwxyz")
    files = list(files.items())
    existing = paths(files) if target == "/r" else {f"/t/{rng.choice(['d', 'd/e', 'f'])}/{rng.choice('abcAB')}{rng.choice(['', '-duplicate-001', '-duplicate-002', '-duplicate-004'])}{rng.choice(['.j', '.J', '.', '.k'])}" for _ in range(40)}
    df, on_disk = inventory(spark, files), spark.createDataFrame([(p,) for p in existing], "path string")
    o = RenameOptions("/r", None if target == "/r" else target)
    for query, new_name, key in (
        (commands.content_hash(o), strip, lambda path, name, content: content),
        (commands.lower(o), lambda n: strip(n).lower(), lambda path, name, content: path),
    ):
        assert planned(query.plan(df, on_disk)) == rename(files, new_name, key, existing, "/r", target)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("target", ["/r", "/t"])
def test_divided_trees(spark, tmp_path, monkeypatch, seed, target):
    """Large inventories: groups in buckets, carried over by prefix sums, and taken numbers in intervals and bins, give the same plan."""
    monkeypatch.setattr(plans, "LARGE_BYTES", 0)
    monkeypatch.setattr(plans, "TASK_ROWS", 17)
    monkeypatch.setattr(plans, "BIN", 3)
    rng = random.Random(seed)
    files = {f"/r/{rng.choice(['d', 'd/e', 'f'])}/{rng.choice('abcdefgh')}{i % 40}{rng.choice(['', '-duplicate-00' + rng.choice('123')])}.{rng.choice('jk')}": "hot" if i % 3 == 0 else rng.choice("uvwxyz") for i in range(200)}
    files = list(files.items())
    existing = paths(files) if target == "/r" else {f"/t/{d}/{n}{m}.{e}" for _, (d, n, m, e) in zip(range(150), iter(lambda: (rng.choice(["d", "d/e", "f"]), rng.choice("abcdefgh") + str(rng.randrange(40)), rng.choice(["", "", "-duplicate-001", "-duplicate-002", "-duplicate-004"]), rng.choice("jk")), None))}
    first = sorted(p for p, c in files if c == "hot")[0].rpartition("/")[2]
    plain, ext = split(strip(first))
    if target == "/t":  # the hot group's targets are there, and many of their numbers
        existing |= {f"/t/{d}/{plain}{m}.{ext}" for d in ("d", "f") for m in ["", *(f"-duplicate-{k:03d}" for k in range(1, 60) if k % 4 < 2 or k > 50)]}
    inventory(spark, files).repartition(3).write.parquet(f"{tmp_path}/files")
    df, on_disk = spark.read.parquet(f"{tmp_path}/files"), spark.createDataFrame([(p,) for p in existing], "path string")
    o = RenameOptions("/r", None if target == "/r" else target)
    for query, new_name, key in (
        (commands.content_hash(o), strip, lambda path, name, content: content),
        (commands.lower(o), lambda n: strip(n).lower(), lambda path, name, content: path),
    ):
        assert planned(query.plan(df, on_disk)) == rename(files, new_name, key, existing, "/r", target)


def test_companions_of_divided_inventories(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(f"/r/{rng.choice('ab')}/I{i}.{e}", (f"2024:01:20 12:10:0{0 if i % 3 == 0 else rng.randrange(9)}", None) if e != "mov" else None) for i in range(60) for e in rng.sample(["JPG", "HEIC", "mov"], 2)]
    kind = "path string, exif struct<date_time_original:string,sub_sec_time_original:string>"
    expected = planned(commands.exif_date(RenameOptions("/r")).plan(spark.createDataFrame(rows, kind)))
    monkeypatch.setattr(plans, "LARGE_BYTES", 0)
    monkeypatch.setattr(plans, "TASK_ROWS", 10)
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/files")
    assert planned(commands.exif_date(RenameOptions("/r")).plan(spark.read.parquet(f"{tmp_path}/files"))) == expected


def test_a_hot_group_is_spread(spark, tmp_path, monkeypatch):
    """A third of all files with one content: no bucket has over twice a task's rows, and plans are as without buckets."""
    spark.range(30_000).selectExpr("concat('/r/d', id % 7, '/f', id) path", "if(id % 3 = 0, 'hot', string(id div 2)) content").write.parquet(f"{tmp_path}/files")
    df = spark.read.parquet(f"{tmp_path}/files")
    query = commands.content_hash(RenameOptions("/r", "/t"))
    expected = query.plan(df).orderBy("source_path").collect()
    monkeypatch.setattr(plans, "TASK_ROWS", 1000)
    rows = plans.divide(query.rows(df))
    sizes = [r["count"] for r in rows.groupBy("group_key", "bucket").count().orderBy(F.desc("count")).collect()]
    assert 10 <= sum(n > 100 for n in sizes) and sizes[0] <= 2000
    monkeypatch.setattr(plans, "LARGE_BYTES", 0)
    assert query.plan(df).orderBy("source_path").collect() == expected


def test_free_numbers_of_a_hot_group(spark, tmp_path):
    """The k-th of 20,000 files of one target takes the k-th free number, in bins, not in one task."""
    n = 20_000
    files = spark.range(n).selectExpr("concat('/r/', lpad(id, 6, '0'), '.j') path", "'hot' content")
    taken = [("/t/000000.j",)] + [(f"/t/000000-duplicate-{k:03d}.j",) for k in range(1, 3 * n // 2, 3)]
    got = commands.content_hash(RenameOptions("/r", "/t")).plan(files, spark.createDataFrame(taken, "path string")).orderBy("source_path").select("dup_no").collect()
    held = set(range(1, 3 * n // 2, 3))
    free = (k for k in range(1, 3 * n) if k not in held)
    assert [r.dup_no for r in got] == [next(free) for _ in range(n)]


@pytest.mark.parametrize("bounds", [["b"], ["b", "d"], ["a", "c", "e", "g", "i"], [f"{i:03}" for i in range(0, 300, 3)]])
def test_buckets(spark, bounds):
    paths_ = sorted({*bounds, *(b + "x" for b in bounds), "", "z", "é"})
    got = {r.path: r.b for r in spark.createDataFrame([(p,) for p in paths_], "path string").select("path", plans._bucket(F.col("path"), bounds).alias("b")).collect()}
    assert got == {p: sum(b <= p for b in bounds) for p in paths_}


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("target", ["/r", "/t"])
def test_distinct_targets(spark, seed, target):
    """No two rows share a target, none meets a file that stays; rows that didn't clash keep theirs."""
    rng = random.Random(seed)
    files = list({f"/r/{rng.choice(['d', 'd/e'])}/{rng.choice('abAB')}{rng.choice(['', '-duplicate-00' + rng.choice('123')])}{rng.choice(['.j', '', '.'])}": rng.choice("uvwxyz") for _ in range(80)}.items())
    existing = paths(files) if target == "/r" else {f"/t/{rng.choice(['d', 'd/e'])}/{rng.choice('abAB')}{rng.choice(['', '-duplicate-001', '-duplicate-002', '-duplicate-004'])}{rng.choice(['.j', '.'])}" for _ in range(30)}
    df, there = inventory(spark, files), spark.createDataFrame([(p,) for p in existing], "path string")
    o = RenameOptions("/r", None if target == "/r" else target)
    before = planned(commands.content_hash(o).plan(df, there))
    after = planned(commands.content_hash(dataclasses.replace(o, distinct_targets=True)).plan(df, there))
    targets = [t for t, _, _ in after.values()]
    stays = existing - set(after)
    assert set(before) == set(after) and len(set(targets)) == len(targets) and not stays & {t for p, (t, _, _) in after.items() if t != p}
    taken = Counter(t for t, _, _ in before.values())
    for p, (t, _, n) in before.items():
        if taken[t] == 1 and t not in stays:
            assert after[p][0] == t and after[p][2] == n
    assert any(c > 1 for c in taken.values()) or any(t in stays for t in taken)


def test_names_without_extension_may_stay(spark):
    """strict_names=False: no dot is added, and numbers that are taken are met without one."""
    o = RenameOptions("/r", "/t", strict_names=False)
    df = inventory(spark, [("/r/README", "x"), ("/r/a/Readme", "x"), ("/r/.Hidden", "y"), ("/r/b/.hid", "y"), ("/r/x.TXT", "z"), ("/r/e.", "w")])
    on_disk = spark.createDataFrame([("/t/README",), ("/t/README-duplicate-001",), ("/t/.Hidden",)], "path string")
    got = {k: v[0] for k, v in planned(commands.content_hash(o).plan(df, on_disk)).items()}
    assert got == {"/r/README": "/t/README-duplicate-002", "/r/a/Readme": "/t/a/README-duplicate-003", "/r/.Hidden": "/t/.Hidden-duplicate-001", "/r/b/.hid": "/t/b/.Hidden-duplicate-002", "/r/x.TXT": "/t/x.TXT", "/r/e.": "/t/e"}
    got = {k: v[0] for k, v in planned(commands.lower(RenameOptions("/r", strict_names=False)).plan(df)).items()}
    assert got == {"/r/README": "/r/readme", "/r/a/Readme": "/r/a/readme", "/r/.Hidden": "/r/.hidden", "/r/x.TXT": "/r/x.txt", "/r/e.": "/r/e"}


def test_options():
    for bad in ({"copy": True}, {"skip_duplicates": True}):
        with pytest.raises(ValueError):
            RenameOptions("/r", **bad)
    assert RenameOptions("/r//", "/t/").source_dir == "/r" and RenameOptions("/r/").target_root == "/r"
    for build in (commands.pattern, commands.date):
        with pytest.raises(ValueError):
            build(RenameOptions("/r"), replacement=None)


def test_one_exchange(spark):
    """Grouping, targets, ordinals and counters share one exchange on the key."""
    df = commands.content_hash(RenameOptions("/r", "/t")).plan(inventory(spark, [("/r/a", "x")]))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

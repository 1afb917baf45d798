"""The rename plan: grouping, targets, ordinals and duplicate numbers.

Rows of a group are ordered by (phase, path). All per-group values share one exchange on the group key and one sort.

Rows of large inventories are written once and divided: paths that stand at equal distances in a sample of all paths cut the order into buckets of about
``TASK_ROWS`` rows, so even a group that holds a third of all rows has no more than that in one of them. What a row needs to know of the rows before it is then a sum over
its own (group, bucket), plus a prefix sum over the summaries of the group's earlier buckets (its first row, rows, no-ops, needs), of which a group has few.

Numbers that are taken on disk are kept as intervals. A group's files that share a target, one after the other, are a run; only runs, not
files, go through a counter that walks over the intervals, and gives each run the number it begins at. A file's own number is the free number of a rank, which
is met by a join of ranks with the free intervals, cut into bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.functions import names as N
from filewright.operators.staging import estimated_bytes, written

#: Rows of a group that a task has at a time in a large inventory; the estimated bytes from which one is large; sampled paths a bucket; ranks a bin.
TASK_ROWS, LARGE_BYTES, SAMPLED, BIN = 1 << 20, 1 << 30, 64, 1024


def ordered(chunked: bool = False) -> Window:
    return Window.partitionBy("group_key", *(["bucket"] if chunked else [])).orderBy("phase", "path")


def _bucket(path: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at most the path, found by halving."""
    held = F.array(*[F.lit(b) for b in bounds])
    halves = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    reached = lambda at, step: (at + step <= len(bounds)) & (F.get(held, at + step - 1) <= path)
    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))


#: What planning needs of a row.
COLUMNS = ["path", "dir", "filename", "stem", "ext", "t_stem", "t_ext", "group_key", "phase"]


def divided(rows: DataFrame) -> DataFrame:
    """Rows of a large inventory with their bucket, written once; others as they are."""
    rows = rows.select(*COLUMNS)
    size = estimated_bytes(rows)
    return divide(written(rows, "rows")) if size is not None and size > LARGE_BYTES else rows


def divide(rows: DataFrame) -> DataFrame:
    """Adds bucket to a written table's rows, if they are more than a task's: the order by (phase, path) cut into even parts."""
    n = rows.count()
    parts = -(-n // TASK_ROWS)
    if parts < 2:
        return rows
    sample = rows.select("path").sample(min(1.0, 1.2 * SAMPLED * parts / n), seed=0)
    paths = sorted(r.path for r in sample.limit(2 * SAMPLED * parts).collect())  # a bounded number for each part
    bounds = sorted({paths[len(paths) * k // parts] for k in range(1, parts)}) if paths else []
    if not bounds:
        return rows
    return rows.withColumn("bucket", F.col("phase") * (len(bounds) + 1) + _bucket(F.col("path"), bounds))


def over_groups(rows: DataFrame, first: dict[str, Column] | None = None, running: dict[str, Column] | None = None, largest: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each row, values of its group's first row, sums over the group's rows up to it, and the group's largest values."""
    first, running, largest = first or {}, running or {}, largest or {}
    chunked = "bucket" in rows.columns
    own = ordered(chunked).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not chunked:
        added = {n: F.first(c).over(ordered()) for n, c in first.items()} | {n: F.sum(c).over(own) for n, c in running.items()}
        return rows.withColumns(added | {n: F.max(c).over(Window.partitionBy("group_key")) for n, c in largest.items()})
    place = F.struct("phase", "path")
    sums = [F.min_by(F.struct(*[c.alias(n) for n, c in first.items()]), place).alias("_first")] if first else []
    sums += [F.sum(c).alias(f"_sum_{n}") for n, c in running.items()] + [F.max(c).alias(f"_max_{n}") for n, c in largest.items()]
    chunks = rows.groupBy("group_key", "bucket").agg(*sums)
    by_bucket = Window.partitionBy("group_key").orderBy("bucket")
    bases = {f"_sum_{n}": F.coalesce(F.sum(f"_sum_{n}").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in running}
    bases |= {f"_max_{n}": F.max(f"_max_{n}").over(Window.partitionBy("group_key")) for n in largest}
    chunks = chunks.withColumns(bases | ({"_first": F.first("_first").over(by_bucket)} if first else {}))
    met = rows.join(chunks, ["group_key", "bucket"])
    added = {n: F.col(f"_first.{n}") for n in first} | {n: F.col(f"_sum_{n}") + F.sum(c).over(own) for n, c in running.items()} | {n: F.col(f"_max_{n}") for n in largest}
    return met.withColumns(added).drop(*[c for c in chunks.columns if c.startswith("_")])


def with_targets(inventory: DataFrame, new_name: Column, key: Column, source_root: str, target_root: str, nullable_key: bool = True, keep_unnamed: bool = False, nullable_name: bool = True) -> DataFrame:
    """Adds new_name, target_path, t_stem, t_ext, group_key and phase 0; rows without a name or key go, or stay with null columns.

    A key made from the target (``nullable_key`` false) is never null, nor is a name that every path has (``nullable_name`` false): not asking
    saves working the name out again below it.
    """
    df = N.decomposed(inventory if nullable_name else inventory.where(F.col("path").isNotNull())).withColumn("new_name", new_name)
    df = df.where(F.col("new_name").isNotNull()) if nullable_name and not keep_unnamed else df
    df = df.withColumns({"target_path": N.target_path(F.col("dir"), F.col("new_name"), source_root, target_root), "t_stem": N.stem(F.col("new_name")), "t_ext": N.extension(F.col("new_name"))})
    df = df.withColumn("group_key", key)
    return (df.where(F.col("group_key").isNotNull()) if nullable_key and not keep_unnamed else df).withColumn("phase", F.lit(0))


def group_targets(rows: DataFrame, source_root: str, target_root: str, own_extension: bool = False, strict: bool = True) -> DataFrame:
    """Adds g_stem, g_ext (of the group's first row), t_dir and target: the row's own directory with the group's name."""
    df = over_groups(rows, first={"g_stem": F.col("t_stem"), "g_ext": F.col("t_ext")}).withColumn("t_dir", N.target_directory(F.col("dir"), source_root, target_root))
    df = df.withColumn("end_ext", F.col("ext") if own_extension else F.col("g_ext"))
    return df.withColumn("target", F.concat("t_dir", F.lit("/"), N.joined(F.col("g_stem"), F.col("end_ext"), strict)))


def without_first_noop(rows: DataFrame) -> DataFrame:
    """Drops each group's first row whose target is its path; later such rows stay. Leaves idx, the ordinal of those that stay."""
    same = (F.col("path") == F.col("target")).cast("int")
    df = over_groups(rows, running={"noops": same, "nth": F.lit(1)})
    df = df.withColumn("idx", (F.col("nth") - 1 - F.least("noops", F.lit(1))).cast("int"))
    return df.where(~((F.col("path") == F.col("target")) & (F.col("noops") == 1))).drop("noops", "nth")


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Adds idx, where ``without_first_noop`` hasn't."""
    if "idx" in rows.columns:
        return rows
    return over_groups(rows, running={"nth": F.lit(1)}).withColumn("idx", (F.col("nth") - 1).cast("int")).drop("nth")


#: A path with a duplicate number.
NUMBERED = rf"(?s){N.MARKER}([0-9]{{3}}|[1-9][0-9]{{3,8}})(\.[^./]*)?\z"


def numbers_on_disk(existing: DataFrame) -> DataFrame:
    """target, number of the paths on disk with a duplicate number: what the target would be without it."""
    plain, number = F.regexp_replace("path", NUMBERED, "$2"), F.regexp_extract("path", NUMBERED, 1).cast("int")
    return existing.where(F.col("path").rlike(NUMBERED)).select(plain.alias("target"), number.alias("number"))


def with_exists(rows: DataFrame, existing: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Adds exists, whether the target is among the paths on disk, and occupied, whether any of its duplicate numbers is.

    numbers: those of ``existing``, if they are worked out already.
    """
    own = existing.select(F.col("path").alias("target"), F.lit(None).cast("int").alias("number"))
    every = own.unionByName(numbers_on_disk(existing) if numbers is None else numbers)
    found = every.groupBy("target").agg(F.max(F.col("number").isNull()).alias("exists"), F.max(F.col("number").isNotNull()).alias("occupied"))
    false = F.lit(False)
    return rows.join(found, "target", "left").withColumns({"exists": F.coalesce("exists", false), "occupied": F.coalesce("occupied", false)})


def needs_number() -> Column:
    return F.col("exists") | (F.col("idx") > 0)


def counted(rows: DataFrame) -> DataFrame:
    """Adds dup_no: the running number of the rows that need one, where no number is taken."""
    df = over_groups(rows, running={"running": needs_number().cast("int")})
    return df.withColumn("dup_no", F.when(needs_number(), F.col("running").cast("int"))).drop("running")


def taken_intervals(numbers: DataFrame) -> DataFrame:
    """target, a, b: the taken numbers of each target as intervals from a to b that don't touch; taken: how many numbers lie before."""
    numbers = numbers.distinct()
    island = F.col("number") - F.row_number().over(Window.partitionBy("target").orderBy("number"))
    joined = numbers.withColumn("island", island).groupBy("target", "island").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    before = Window.partitionBy("target").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select("target", "a", "b", F.coalesce(F.sum(F.col("b") - F.col("a") + 1).over(before), F.lit(0)).alias("taken"))


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by group and order, each with its taken intervals behind it, to the number that each begins at and how many free ones lie before.

    Of a run, k numbers are wanted from the counter on, without the taken ones; the counter then stands behind the last. Holds a counter only.
    """
    names = ["group_key", "bucket", "run", "begin", "free"]
    group = run = None
    counter, begin, below, left = 1, 1, 0, 0

    def ended() -> tuple:
        return group, *run, begin, begin - 1 - below

    for batch in batches:
        out = []
        for key, bucket, number, k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != group or (bucket, number) != run:
                if run is not None:
                    out.append(ended())
                    counter += left
                if key != group:
                    group, counter = key, 1
                run, begin, below, left = (bucket, number), counter, 0, k
            if a is None:
                continue
            if b < begin:
                below += b - a + 1
            elif a < begin:
                below, counter = below + begin - a, b + 1
            elif left:
                free = min(left, a - counter)
                left, counter = left - free, counter + free
                if left:
                    counter = b + 1
        yield _run_rows(out, names)
    if run is not None:
        yield _run_rows([ended()], names)


def _run_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _between_taken(files: DataFrame, numbers: DataFrame) -> DataFrame:
    """path, own_no of the files that need a number, of groups some of whose numbers are taken."""
    files = files if "bucket" in files.columns else files.withColumn("bucket", F.lit(0))
    w = ordered(True)
    changes = F.coalesce((F.col("target") != F.lag("target").over(w)).cast("int"), F.lit(1))
    files = files.where(needs_number()).select("group_key", "bucket", "phase", "path", "target", "exists", changes.alias("changes"))
    files = files.withColumn("run", F.sum("changes").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    files = files.withColumn("nth", F.row_number().over(Window.partitionBy("group_key", "bucket", "run").orderBy("phase", "path")))
    files, intervals = written(files, "files"), written(taken_intervals(numbers), "intervals")
    runs = files.groupBy("group_key", "bucket", "run").agg(F.first("target").alias("target"), F.first("exists").alias("exists"), F.count("*").alias("k"))
    no = F.lit(None).cast("int")
    walls = runs.where("exists").join(intervals, "target").select("group_key", "bucket", "run", "k", "a", "b")
    sent = runs.select("group_key", "bucket", "run", "k", no.alias("a"), no.alias("b")).unionByName(walls)
    begins = sent.repartition("group_key").sortWithinPartitions("group_key", "bucket", "run", F.asc_nulls_first("a")).mapInArrow(_begins, "group_key string, bucket int, run long, begin long, free long")
    placed = files.join(written(begins, "begins"), ["group_key", "bucket", "run"])
    unchecked = placed.where("not exists").select("path", (F.col("begin") + F.col("nth") - 1).alias("own_no"))
    # of a file whose number has to be free: its rank among its target's free numbers, and the interval of free numbers that holds the rank
    ranked = placed.where("exists").select("path", "target", (F.col("free") + F.col("nth")).alias("rank"))
    most = ranked.groupBy("target").agg(F.max("rank").alias("most"))
    by_place = Window.partitionBy("target").orderBy("a")
    ahead = F.col("a") - 1 - F.col("taken")  # free numbers before the interval
    behind = intervals.select("target", ahead.alias("low"), F.lead(ahead).over(by_place).alias("high"), (F.col("taken") + F.col("b") - F.col("a") + 1).alias("add"))
    front = intervals.where("taken = 0").select("target", F.lit(0).alias("low"), ahead.alias("high"), F.lit(0).alias("add"))
    free = most.join(behind.unionByName(front), "target", "left").select("target", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce(F.least("high", "most"), "most").alias("high"), F.coalesce("add", F.lit(0)).alias("add")).where("low < high")
    bins = free.withColumn("bin", F.explode(F.sequence(F.floor((F.col("low") + 1) / BIN), F.floor(F.col("high") / BIN))))
    found = ranked.withColumn("bin", F.floor(F.col("rank") / BIN)).join(bins, ["target", "bin"]).where("rank > low and rank <= high")
    return unchecked.unionByName(found.select("path", (F.col("rank") + F.col("add")).alias("own_no")))


def numbered(rows: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Adds exists and dup_no; with numbers on disk, each existing target takes the next free one.

    The numbers on disk, as a rule none or few, are written first. Without any, windows count; else what they have counted is written once.
    """
    if existing is None:
        return counted(rows.withColumn("exists", F.lit(False)))
    numbers = written(numbers_on_disk(existing), "numbers_on_disk")
    if numbers.isEmpty():
        return counted(with_exists(rows, existing, numbers)).drop("occupied")
    df = over_groups(with_exists(rows, existing, numbers), largest={"taken": F.col("occupied")})
    df = written(counted(df).drop("occupied"), "counted")
    own = F.when(F.col("taken"), F.col("own_no").cast("int")).otherwise(F.col("dup_no"))
    return df.join(_between_taken(df.where("taken"), numbers), "path", "left").withColumn("dup_no", own).drop("taken", "own_no")


def finished(rows: DataFrame, skip_duplicates: bool = False, copy: bool = False, strict: bool = True) -> DataFrame:
    """source_path, target_path, group_key, idx, dup_no, is_duplicate, action."""
    name = F.when(F.col("dup_no").isNull(), F.col("target")).otherwise(F.concat("t_dir", F.lit("/"), N.duplicate_name(F.col("g_stem"), F.col("dup_no"), F.col("end_ext"), strict)))
    df = rows.select(F.col("path").alias("source_path"), name.alias("target_path"), "group_key", "idx", "dup_no")
    df = df.withColumn("is_duplicate", N.is_duplicate(N.filename(F.col("target_path"))))
    act = F.lit("copy" if copy else "move")
    return df.withColumn("action", F.when(F.col("is_duplicate") & F.lit(skip_duplicates), "skip").otherwise(act))


def rename_plan(rows: DataFrame, source_root: str, target_root: str, existing: DataFrame | None = None, own_extension: bool = False, skip_duplicates: bool = False, copy: bool = False, strict: bool = True) -> DataFrame:
    """The whole plan from rows with targets and keys."""
    df = with_ordinal(without_first_noop(group_targets(divided(rows), source_root, target_root, own_extension, strict)))
    return finished(numbered(df, existing), skip_duplicates, copy, strict)


def resolved(plan: DataFrame, existing: DataFrame | None = None, skip_duplicates: bool = False) -> DataFrame:
    """The plan without targets that several rows share, or that are on disk and stay there: such rows, but the first by (group_key, idx), get further numbers.

    A row's place is its target without number. Its new number lies beyond all numbers that the plan or the disk has at that place, so one pass is enough. Rows
    that are skipped keep their targets; a plan without such targets stays as it is.
    """
    sources = plan.where("action <> 'skip'").select(F.col("source_path").alias("path"))
    stays = None if existing is None else existing.select("path").join(sources, "path", "left_anti").distinct().select(F.col("path").alias("target_path"), F.lit(True).alias("stays"))
    acts = (F.col("action") != "skip").cast("int")
    nth = F.sum(acts).over(Window.partitionBy("target_path").orderBy(F.col("source_path") != F.col("target_path"), "group_key", "idx", "source_path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = plan.withColumn("nth", nth)
    rows = rows.withColumn("stays", F.lit(False)) if stays is None else rows.join(stays, "target_path", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    clash = (F.col("action") != "skip") & ((F.col("nth") > 1) | F.col("stays")) & (F.col("source_path") != F.col("target_path"))
    rows = written(rows.withColumns({"clash": clash, "place": F.regexp_replace("target_path", NUMBERED, "$2")}).drop("nth", "stays"), "targets")
    clashing = rows.where("clash").select("source_path", "place", F.row_number().over(Window.partitionBy("place").orderBy("target_path", "group_key", "idx", "source_path")).alias("further"))
    held = numbers_on_disk(plan.select(F.col("target_path").alias("path")) if existing is None else existing.select("path").unionByName(plan.select(F.col("target_path").alias("path"))))
    highest = held.groupBy(F.col("target").alias("place")).agg(F.max("number").alias("highest"))
    numbers = clashing.join(highest, "place", "left").select("source_path", (F.coalesce("highest", F.lit(0)) + F.col("further")).cast("int").alias("new_no"))
    place, name = F.col("place"), N.filename(F.col("place"))
    ext = N.extension(name)
    stem = F.when(ext == "", place).otherwise(F.left(place, F.length(place) - F.length(ext) - 1))
    end = F.when((ext == "") & ~F.endswith(place, F.lit(".")), "").otherwise(F.concat(F.lit("."), ext))
    new = F.concat(F.when(F.endswith(place, F.lit(".")), F.left(place, F.length(place) - 1)).otherwise(stem), F.lit(N.MARKER), F.format_string("%03d", "new_no"), end)
    met = rows.join(numbers, "source_path", "left").withColumns({"target_path": F.when(F.col("new_no").isNotNull(), new).otherwise(F.col("target_path")), "dup_no": F.coalesce("new_no", "dup_no")})
    met = met.withColumn("is_duplicate", N.is_duplicate(N.filename(F.col("target_path"))))
    return met.withColumn("action", F.when(F.col("is_duplicate") & F.lit(skip_duplicates), "skip").otherwise(F.col("action"))).select(*plan.columns)


def with_collisions(plan: DataFrame) -> DataFrame:
    """Adds collision: whether another row of the plan has the same target."""
    return plan.withColumn("collision", F.count("*").over(Window.partitionBy("target_path")) > 1)

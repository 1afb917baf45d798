"""Rows keep their numbers when executors come or go: the cores that are there change between the steps of each operator."""

import random

import pytest
from data import COLUMNS, frame, words

from filewright.llm import common, decontamination, exact_dedup, near_dedup, repeats
from filewright.llm.common import numbered, repeatable, shared_dir


@pytest.fixture
def many_files(spark):
    """A table of 12 files with copies, near copies, repeated and null ids, and passages of a benchmark."""
    rng = random.Random(4)
    base = [words(rng, 80) for _ in range(40)]
    texts = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i % 7]) for i in range(60)] + [(200 + i, base[i].replace(" ", " x ", 1)) for i in range(30)]
    texts += [(300, None), (None, base[0]), (None, base[1]), (5, base[2]), (5, base[2])]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 0, 7, None, 0.5, "x") for i, t in texts]
    path = shared_dir(spark, "many")
    spark.createDataFrame(rows, COLUMNS).repartition(12).write.parquet(path)
    return spark.read.parquet(path), spark.createDataFrame([(i, base[i]) for i in (3, 20)], "item_id long, text string")


@pytest.fixture
def unsteady(spark, monkeypatch):
    """Whenever a table is written, the cores that the next scan is divided for are others."""
    turn = [0]

    def flipping(df, label, own=common.staged):
        out = own(df, label)
        turn[0] += 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", (64, 2, 7)[turn[0] % 3])
        return out

    for module in (common, decontamination, exact_dedup, near_dedup, repeats):
        monkeypatch.setattr(module, "staged", flipping)
    yield lambda: turn[0]
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def numbers(spark, df, cores):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
    rows, row = numbered(df)
    return sorted((r[row], repr(r.doc_id), r.text or "") for r in rows.collect())


def test_numbers(spark, many_files):
    docs, _ = many_files
    try:
        first = numbers(spark, docs, 64)
        assert first == numbers(spark, docs, 2) and len({n for n, _, _ in first}) == len(first) == docs.count()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert repeatable(docs) is docs and repeatable(docs.where("doc_id > 1").select("doc_id", "text")).columns == ["doc_id", "text"]


def test_other_plans_are_written_once(spark):
    for df in (frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(1, "a")]).repartition(3), spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("file_number", common.F.lit(3))):
        again = repeatable(df)
        assert again is not df and numbered(again)[0].columns == [*df.columns, numbered(again)[1]]


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("operator", ["exact", "near", "leaks", "clean", "repeats"])
def test_operators(spark, many_files, request, operator):
    docs, items = many_files
    run = {
        "exact": lambda: exact_dedup.exact_dedup(docs).select("doc_id", "text"),
        "near": lambda: near_dedup.near_dedup(docs).select("doc_id", "text"),
        "leaks": lambda: decontamination.leaks(docs, items),
        "clean": lambda: decontamination.decontaminate(docs, items).select("doc_id", "text"),
        "repeats": lambda: repeats.deduplicated(docs),
    }[operator]
    steady = plain(run())
    writes = request.getfixturevalue("unsteady")
    assert plain(run()) == steady and writes() > 1
    if operator == "exact":
        assert len(steady) == docs.selectExpr("lower(coalesce(text, '')) t").distinct().count()

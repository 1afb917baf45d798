import zlib
from collections import Counter

from data import awkward, frame
from pyspark.sql import functions as F

from filewright.llm.sharding import RACK, REGION, SHARD, assign, draw, op3_sharding, tree


def test_law(spark):
    texts = awkward() + [(i, "x") for i in range(100, 3000)]
    got = assign(frame(spark, texts), 24).collect()
    assert len(got) == len(texts)
    sizes = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    assert Counter((r["size"], r.text_crc32) for r in got) == sizes
    slots = {}
    for r in got:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of_id = {}
    for r in got:
        if r.doc_id is not None:
            assert of_id.setdefault(r.doc_id, r.shard) == r.shard
    moved = sum(r.grown_shard == 24 for r in got) / len(got)
    assert 0.02 < moved < 0.06 and max(map(len, slots.values())) < 1.5 * len(got) / 24


def test_growth_takes_rows_only_into_the_new_shard(spark):
    df = frame(spark, [(i, "") for i in range(3000)])
    before = {r.doc_id: r.shard for r in assign(df, 8).collect()}
    for shards in range(8, 13):
        got = assign(df, shards, planned=8).collect()
        assert {r.doc_id: r.shard for r in got} == before
        assert all(r.grown_shard in (r.shard, shards) for r in got) and 0.04 < sum(r.grown_shard == shards for r in got) / 3000 < 0.16
        before = {r.doc_id: r.grown_shard for r in got}


def test_weights_move_rows_only_in_subtrees_that_change(spark):
    df = frame(spark, [(i, "") for i in range(6000)])
    place = {x.shard: (x.region, x.rack) for x in tree(24)}
    one = {r.doc_id: r.shard for r in assign(df, 24).collect()}
    two = {r.doc_id: r.shard for r in assign(df, 24, weights={3: 3.0}).collect()}  # of region 0, rack 0
    for i, s in one.items():
        if s != two[i]:
            (a, b), (c, d) = place[s], place[two[i]]
            assert c == 0 and (a != 0 or d == 0)  # into the region that grew; within it, into the rack
            assert a != 0 or b != 0 or two[i] == 3  # and within the rack, into the shard
    share = Counter(two.values())[3] / 6000
    assert abs(share - 3 / 26) < 0.02 and all(abs(n / 6000 - 1 / 26) < 0.015 for s, n in Counter(two.values()).items() if s != 3)
    none = {r.shard for r in assign(df, 24, weights={s: 0.0 for s in range(4)}).collect()}
    assert none == set(range(4, 24))


def test_descent_against_brute_force(spark):
    """Each row's path, by the draws of all nodes worked out one by one."""
    weights = {2: 2.0, 9: 0.5}
    leaves = tree(13, 12, weights)
    df = frame(spark, [(i, "") for i in range(300)])
    keyed = df.select("doc_id", F.xxhash64("doc_id").alias("key"))
    nodes = {(level, n): sum(x.weight for x in leaves if of(x) == n) for level, of in ((REGION, lambda x: x.region), (RACK, lambda x: x.rack), (SHARD, lambda x: x.shard)) for n in {of(x) for x in leaves}}
    drawn = keyed.select("doc_id", *[draw(F.col("key"), level, n, w).alias(f"{level}_{n}") for (level, n), w in nodes.items()]).collect()
    got = {r.doc_id: r.grown_shard for r in assign(df, 12, weights=weights).collect()}
    for r in drawn:
        region = min({x.region for x in leaves}, key=lambda n: r[f"{REGION}_{n}"])
        rack = min({x.rack for x in leaves if x.region == region}, key=lambda n: r[f"{RACK}_{n}"])
        assert got[r.doc_id] == min({x.shard for x in leaves if x.rack == rack}, key=lambda n: r[f"{SHARD}_{n}"])


def test_tree_and_empty(spark):
    assert [(x.region, x.rack) for x in tree(10)] == [(0, 0)] * 4 + [(0, 1)] * 4 + [(1, 2)] * 2
    assert [(x.region, x.rack) for x in tree(11, 9)][8:] == [(1, 2), (2, 3), (3, 4)]
    assert assign(frame(spark, []), 24).count() == 0


def test_query_columns(spark, sf_dir):
    rows = op3_sharding(spark, sf_dir).collect()
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r.law for r in rows} == {"key"}
    assert all((r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode())) for r in rows)

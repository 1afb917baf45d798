"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row descends to the child with the smallest draw: an exponential variate from a hash of the key and the child, divided by the
child's weight, which is the sum of the weights below it. So a node is taken with probability proportional to its weight, and a row costs
one draw for each child on its path (3 + 2 + 4 for 24 shards). A change of weight changes the draws of the nodes above it alone: rows move into or out
of these, and none moves between subtrees whose weights stay.

The tree is laid out for ``planned`` shards; each shard beyond these is a region of its own, a new child of the root. One more shard thus takes
rows only into itself (law ``key``: the id and the number of shards decide).

Slots are gapless in each shard. Rows are numbered within (shard, bucket), where buckets spread rows by a row number, not
by the key, so no key's rows meet in one task; the bases are prefix sums over shards x buckets counts.

Defined results: a null id is replaced by the text's hash as the key; equal ids share a shard; a null text has size 8;
repeated rows each get a slot of their own; a shard of weight 0 gets no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.llm.common import partitions, staged, table, text_or_empty

REGION, RACK, SHARD = 1, 2, 3
RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4


@dataclass(frozen=True)
class Leaf:
    """A shard's place in the tree and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, planned: int | None = None, weights: dict[int, float] | None = None) -> list[Leaf]:
    """The first ``planned`` shards (all, if not given) fill racks and regions in order; each of the others is a region with one rack."""
    planned = shards if planned is None else planned
    racks = -(-planned // SHARDS_PER_RACK)
    regions = -(-racks // RACKS_PER_REGION)
    of = lambda s: (s // (SHARDS_PER_RACK * RACKS_PER_REGION), s // SHARDS_PER_RACK) if s < planned else (regions + s - planned, racks + s - planned)
    return [Leaf(s, *of(s), (weights or {}).get(s, 1.0)) for s in range(shards)]


def draw(key: Column, level: int, node: int, weight: float) -> Column:
    """Exponential with the weight as its rate; 53 bits of the hash make a uniform in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level).cast("long"), F.lit(node).cast("long")), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(weight)


def pick(key: Column, level: int, weights: dict[int, float]) -> Column:
    """The child with the smallest draw."""
    children = [(n, w) for n, w in weights.items() if w > 0]
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.least(*[F.struct(draw(key, level, n, w).alias("d"), F.lit(n).alias("node")) for n, w in children])["node"]


def descend(rows: DataFrame, leaves: list[Leaf], key: str, out: str) -> DataFrame:
    """Adds ``out``, the shard that each row reaches, level by level; only the children on a row's path are drawn."""
    region, rack = f"{out}_region", f"{out}_rack"
    of_region: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for x in leaves:
        of_region[x.region] = of_region.get(x.region, 0) + x.weight
        own = racks.setdefault(x.region, {})
        own[x.rack] = own.get(x.rack, 0) + x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight

    def below(parent: str, level: int, children: dict[int, dict[int, float]]) -> Column:
        return F.coalesce(*[F.when(F.col(parent) == n, pick(F.col(key), level, c)) for n, c in children.items() if any(c.values())])

    rows = rows.withColumn(region, pick(F.col(key), REGION, of_region))
    rows = rows.withColumn(rack, below(region, RACK, racks))
    return rows.withColumn(out, below(rack, SHARD, shards)).drop(region, rack)


def assign(docs: DataFrame, shards: int, planned: int | None = None, id_column: str = "doc_id", text_column: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard), slot."""
    spark = docs.sparkSession
    raw = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.when(F.col(id_column).isNull(), F.xxhash64(raw)).otherwise(F.xxhash64(F.col(id_column))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    planned = shards if planned is None else planned
    rows = descend(descend(rows, tree(shards, planned, weights), "key", "shard"), tree(shards + 1, planned, weights), "key", "grown_shard")
    buckets = max(8, 4 * partitions(spark) // shards)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    rows = staged(rows.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket", "row"), "shards")
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")))
    return numbered.join(bases, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("base") + F.col("at") - 1).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""URL filters by a sort-merge range join.

A host is turned into a canonical key: its labels reversed, each ended by a dot (``blog.example.net`` is
``net.example.blog.``). All hosts at or below a rule's host then form one interval of keys, [key, key with its last dot
raised by one). Pages and rules are range-partitioned by key into the same ranges and sorted; a rule is copied into every range
that its interval meets. A sweep then walks each range once and keeps a stack of the rules' intervals that hold
the current key, which nest; a page asks the stack for the rules whose path starts its own, and the longest rule wins
(of equal length, the deeper host, then the rule's text).

Range bounds come from a sample of the pages' sort keys (about 50 a range reach the driver) and only balance the work. Page number and
path are part of the sort key, so a host with a third of all rows is split over ranges. A sweep holds one Arrow batch and the stack.

Defined results: a null url, or one without ``://``, has an empty host and path; no fitting rule gives a null rule
and the verdict ``allow``; repeated rows are judged each; an empty rule table leaves every row to the default; a rule
given twice counts once (block wins over allow); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import partitions, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SAMPLE_PER_RANGE = 50


def lower_case(host: Column) -> Column:
    """A-Z alone, for pages and rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_case(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page. rules: host, path, verdict."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    rows = rows.withColumn("place", F.concat("key", F.lit("\x01"), "path", F.lit("\x01"), F.lpad(F.hex(F.xxhash64("row")), 16, "0")))
    n = partitions(spark)
    rated = min(1.0, SAMPLE_PER_RANGE * n / max(1, pages.count()))
    bounds = sorted(r[0] for r in rows.select("place").sample(rated, seed=7).collect())
    bounds = [bounds[len(bounds) * i // n] for i in range(1, n)] if bounds else []

    starts = np.array(bounds, object)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, place.to_numpy(object), "right").astype(np.int32))

    def past(key: Column) -> Column:
        """What all keys at or below a rule's lie before: the last dot raised by one, and for no host all of its places."""
        return F.when(key == "", F.lit("\x01\U0010ffff")).otherwise(F.concat(F.left(key, F.length(key) - 1), F.lit("/")))

    asked = rows.select(range_of("place").alias("range"), "place", F.lit(1).alias("kind"), "key", "host", "path", "page_id", F.lit("").alias("verdict"))
    rule_rows = rules.select(lower_case(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule_rows = rule_rows.withColumn("key", host_key(F.col("host"))).withColumn("past", past(F.col("key")))
    rule_rows = rule_rows.withColumn("range", F.explode(F.sequence(range_of("key"), range_of("past"))))
    given = rule_rows.select("range", F.col("key").alias("place"), F.lit(0).alias("kind"), "key", "host", "path", F.lit(None).cast("long").alias("page_id"), "verdict")
    merged = asked.unionByName(given).repartitionById(n, F.col("range")).sortWithinPartitions("range", "place", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for place, _, kind, key, host, path, page, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    at, stack = place, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, []))
                    stack[-1][2].append((path, verdict))
                    continue
                best = None
                for depth, (own, name, paths) in enumerate(stack):
                    if own or not host:  # a rule without a host fits only pages without one
                        for start, says in paths:
                            if path.startswith(start):
                                best = max(best or (-1,), (len(name) + len(start), depth, name + start, says))
                out.append((page, host, path, best and best[2], best[3] if best else default))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.string()] * 4), strict=True)], names=["page_id", "host", "path", "rule", "verdict"])

    return merged.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

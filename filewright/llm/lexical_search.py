"""Ranked lexical search: for each item of a query set, the documents that score highest over its terms, exactly.

Documents are taken as ranges of the scan, ``RANGE`` documents at most (those that hold none of the items' terms are only counted). One scan
writes an index row a range: its documents, their numbers of terms, and the items' terms that each holds. Numbers of documents, terms and
documents a term are sums over the index. Then each task reads ranges of the index and builds, for each term, a tree of maxima over the range:
leaves of ``LEAF`` documents, inner nodes of ``FAN`` children, the root; each node has the term's largest impact below it. For each item, best-first
branch-and-bound descends the nodes with the highest summed bounds (weight times impact over the item's terms), scores the documents of the leaves that it
reaches, and ends when no bound is left that reaches the item's last-ranked score. Nodes whose bound equals it are opened, as an equal score with a smaller id
ranks before. What an item has found in a task's earlier ranges counts in the later ones, so a range is skipped at its root once its bound is too low.
Every task gives at most ``top`` documents an item, which windows rank, first within shares of the tasks, then all.

A weight is floor(1000 ln((2N + 2) / (2 df + 1))), worked out in doubles, an impact (10^9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L; all else is 64-bit
integers. N, L: documents with a term, and their terms; n: a document's terms; df: documents that hold the term; tf: its occurrences in the document.

Items come in blocks of ``VOCABULARY`` different terms at most (or one item), each a search over all documents, so what goes to the tasks is bounded. A range holds at most ``RANGE_BYTES``
of text or one document, and texts are cut slice by slice.

Defined results: null and empty texts hold no term, are not counted in N and never found; an item without terms finds nothing; repeated items are ranked each; repeated
documents are documents of their own; of equal scores the smaller id ranks first, null ids last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.llm.common import releasing, staged, table
from filewright.llm.terms import Numbers, Terms, run_starts

WORDS = Terms(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Documents and bytes of text in a range; documents in a leaf; children of an inner node.
RANGE, RANGE_BYTES, LEAF, FAN = 4096, 1 << 24, 16, 16
VOCABULARY = 1 << 15
#: One row a range: its documents that hold terms of the items, in order; where each one's terms begin; the terms and their occurrences. And sums over all its documents.
INDEX = "docs array<long>, lengths array<long>, starts array<int>, terms array<int>, tfs array<int>, held array<int>, holders array<int>, n_docs long, n_terms long"


def _index(numbers: dict[bytes, int]):
    """(doc_id, text) to ranges of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, found, size, n_docs, n_terms = [], [], [], 0, 0, 0
        get = numbers.get

        def close() -> pa.RecordBatch:
            doc = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            terms, tfs = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            starts = np.searchsorted(doc, np.arange(len(found) + 1))
            held, holders = np.unique(terms, return_counts=True)
            lists = [pa.array([x], pa.list_(t)) for x, t in ((docs, pa.int64()), (lengths, pa.int64()), (starts, pa.int32()), (terms, pa.int32()), (tfs, pa.int32()), (held, pa.int32()), (holders, pa.int32()))]
            return pa.record_batch([*lists, pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                n, parts = 0, []
                for words in WORDS(text):
                    n += len(words)
                    x = np.array([k for k in map(get, words) if k is not None], np.int64)
                    if len(x):
                        parts.append(np.unique(x, return_counts=True))
                if not n:
                    continue
                n_docs, n_terms, size = n_docs + 1, n_terms + n, size + len(text)
                if len(parts) > 1:  # a long text's slices
                    x, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                    tf = np.zeros(len(x), np.int64)
                    np.add.at(tf, back, np.concatenate([c for _, c in parts]))
                    parts = [(x, tf)]
                if parts:
                    docs.append(batch.column(0)[i].as_py())
                    lengths.append(n)
                    found.append(parts[0])
                if len(docs) >= RANGE or size > RANGE_BYTES:
                    yield close()
                    docs, lengths, found, size, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield close()

    return run


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 1 << 63:  # beyond 64 bits in between
        return np.array([25 + (75 * n * n_docs) // n_terms for n in lengths.tolist()], np.int64)
    return 25 + (75 * lengths * n_docs) // n_terms


class RangeTrees:
    """The max trees of all terms over one range of documents.

    terms, tfs: by document; nodes: root, inner nodes and leaves in one row of ``maxima`` a term that the range holds.
    """

    def __init__(self, docs: list, lengths: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        self.docs, self.starts = docs, starts
        m = np.repeat(norms(lengths, n_docs, n_terms), np.diff(starts))
        self.impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)
        self.held, self.terms = np.unique(terms, return_inverse=True)
        #: nodes of each level, root first, and where each level begins among all nodes
        self.widths = [-(-len(docs) // LEAF)]
        while self.widths[0] > 1:
            self.widths.insert(0, -(-self.widths[0] // FAN))
        self.level_at = np.concatenate([[0], np.cumsum(self.widths)])
        leaf = np.repeat(np.arange(len(docs)) // LEAF, np.diff(starts))
        level = np.zeros((len(self.held), self.widths[-1]), np.int64)
        np.maximum.at(level, (self.terms, leaf), self.impacts)
        levels = [level]
        for width in reversed(self.widths[:-1]):
            padded = np.zeros((len(self.held), width * FAN), np.int64)
            padded[:, : level.shape[1]] = level
            level = padded.reshape(len(self.held), width, FAN).max(axis=2)
            levels.insert(0, level)
        self.maxima = np.concatenate(levels, axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], top: int) -> int:
        """Adds to ``best``, a heap of the ``top`` best (score, id is not null, -id), what an item finds here; returns the number of leaves scored."""
        at = np.searchsorted(self.held, terms)
        there = at < len(self.held)
        there[there] = self.held[at[there]] == terms[there]
        at, weights = at[there], weights[there]
        least = lambda: best[0][0] if len(best) == top else 1  # noqa: E731  a bound below it can't give a document that ranks
        if not len(at) or int(weights @ self.maxima[at, 0]) < least():
            return 0
        bounds = weights @ self.maxima[at]
        own = np.zeros(len(self.held), np.int64)
        own[at] = weights
        open_, scored, last = [(-int(bounds[0]), 0, 0)], 0, len(self.widths) - 1
        while open_ and -open_[0][0] >= least():
            _, level, k = heapq.heappop(open_)
            if level < last:
                begin = k * FAN
                below = bounds[self.level_at[level + 1] + begin : self.level_at[level + 1] + min(begin + FAN, self.widths[level + 1])]
                for j in np.flatnonzero(below >= least()).tolist():
                    heapq.heappush(open_, (-int(below[j]), level + 1, begin + j))
                continue
            scored += 1
            begin, end = k * LEAF, min(k * LEAF + LEAF, len(self.docs))
            low, high = self.starts[begin], self.starts[end]
            scores = np.add.reduceat(own[self.terms[low:high]] * self.impacts[low:high], self.starts[begin:end] - low)
            for j in np.flatnonzero(scores >= least()).tolist():
                doc = self.docs[begin + j]
                entry = (int(scores[j]), doc is not None, -(doc or 0))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _search(items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int):
    """Ranges of the index to each item's best documents: item (its number), doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column(0)[i].as_py()
                if docs:
                    lists = [batch.column(k)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5)]
                    trees = RangeTrees(docs, *lists, n_docs, n_terms)
                    for (terms, weights), own in zip(items, best, strict=True):
                        trees.search(terms, weights, own, top)
        rows = [(k, -doc if there else None, score) for k, own in enumerate(best) for score, there, doc in own]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list, list[Counter], Numbers]]:
    """Items' ids, terms (numbered, with repeats) and the terms' numbers, for ``VOCABULARY`` terms at a time."""
    ids, terms, numbers = [], [], Numbers()
    for row in items.select(F.col(id_column), F.col(text_column)).toLocalIterator():
        own = Counter(x for words in WORDS(row[1]) for x in words)
        if not own:
            continue
        if ids and len(numbers.keys() | own.keys()) > VOCABULARY:
            yield ids, terms, numbers
            ids, terms, numbers = [], [], Numbers()
        ids.append(row[0])
        terms.append(Counter({numbers[x]: n for x, n in own.items()}))
    if ids:
        yield ids, terms, numbers


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("text is not null")
    found = None
    for ids, terms, numbers in _blocks(items, item_column, item_text_column):
        index = staged(rows.mapInArrow(releasing(_index(dict(numbers))), INDEX), "search_index")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            break
        holders = index.select(F.explode(F.arrays_zip("held", "holders")).alias("x")).groupBy("x.held").agg(F.sum("x.holders").alias("n"))
        df = dict(holders.collect())  # one row a term of the block
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [sorted((t, n * weight[t]) for t, n in own.items() if t in weight) for own in terms]
        arrays = [(np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)) for own in asked]
        ranked = index.where("size(docs) > 0").select("docs", "lengths", "starts", "terms", "tfs").mapInArrow(releasing(_search(arrays, n_docs, n_terms, top)), "item int, doc_id long, score long")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        for share in ("share", None):
            w = Window.partitionBy("item", *([share] if share else [])).orderBy(*order)
            ranked = (ranked.withColumn("share", F.spark_partition_id() % 256) if share else ranked).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema[item_column].dataType.simpleString()}")
        own = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, unnest({_TERM.format(text="text")}) AS term FROM documents),
sizes AS (SELECT d, doc_id, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS (SELECT d, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERM.format(text="text")}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT i, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (d), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""

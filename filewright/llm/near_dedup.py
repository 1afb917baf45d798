"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text's elements are its different shingles of five lower-case words (all its words, if fewer); an element's weight is its
count times 1 + the mean over its words of ln(N / df) / ln N, df being the number of documents that hold the word. Document
frequencies are gathered over all documents, in ``DF_CELLS`` hashed cells (a fixed 4 MB, which each worker maps).

1. Each text is sampled ``BANDS`` x ``ROWS`` times: two texts draw the same sample with the probability of their weighted
   Jaccard similarity. ``ROWS`` samples make a band's key. At a similarity of 0.8 no band agrees for one pair in 90,000.
   A byte of each sample is kept as the text's sketch.
2. Equal texts are one text from here on (by SHA-256).
3. Texts of one band key are a group. Each is compared with the group's leader, the text that shares most keys with others
   (the original, among edited copies). Links make classes.
4. A group whose texts aren't all in one class is open. In open groups of up to ``SMALL`` texts all pairs of different classes are compared, one of
   them outside the class that most are in. In larger ones, the texts outside (up to ``OUTSIDE``) are compared with all, in blocks of texts
   that are dealt over all tasks; the groups of one main class (of one text's many copies, in every band) are one group for this.
   The texts of open groups with still more texts outside are divided by their rarest shingles, in a way that every pair at 0.8 survives (see
   ``_prefixes``), and 3 and 4 hold for the parts, each with a leader from outside its main class; parts that are open then are compared by pairs or in
   blocks, whatever their size. So a very common passage that draws unlike texts into one group is taken apart, and no pair is given up.
5. A pair is compared by its texts' weights and sketches (fewer than ``ALIKE`` equal bytes of 48 befall one pair at 0.8 in 30,000), and what
   is left by the exact weighted Jaccard similarity; ``SIMILARITY`` or more is a link.
6. Links are turned into classes by star contraction, each step written to the shared folder.

Defined results: null and empty texts have no words: they are copies of the equal texts only; equal texts share a class; a class's id is
its smallest document id (null if all are); repeated rows are copies; an empty table gives no rows; other columns are ignored. A frame
that isn't a scan is written once, so that rows keep their numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filewright.llm.common import drop_staged, filesystem, join_hot, numbered, partitions, releasing, repeatable, shared_dir, staged, table, text_or_empty
from filewright.llm.token_files import open_array

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 3
#: Open groups of up to so many texts are searched by pairs; larger ones of up to so many texts outside the main class in blocks; others are divided once,
#: and their parts are searched by pairs or in blocks.
SMALL, OUTSIDE = 32, 2048
#: Texts outside the main class, and texts of all classes, that meet in a block.
BLOCK_OUTSIDE, BLOCK_ALL = 32, 256
#: Step of the weights by which the parts of large groups are told apart.
WEIGHT_STEP = 1.05
#: Equal bytes of two sketches from which their texts are compared.
ALIKE = 27
DF_CELLS, DF_SLICES = 1 << 20, 64
#: Elements share so many rows of random numbers, by their hash; an element's identity is the whole hash.
RANDOM_ROWS = 1 << 15
BROADCAST_ROWS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether words hold it, and a random number of its lower case."""
    codes = range(0x110000)
    word = np.fromiter((chr(c).isalnum() for c in codes), bool, 0x110000)
    lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in codes), np.uint64, 0x110000)
    return word, _mixed(lower + np.uint64(0x51ED27))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.random.default_rng(3).integers(0, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words in order, and each word's text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    is_word, random = _characters()
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = is_word[code]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(at)))
    offset = np.arange(len(at)) - np.repeat(starts, lengths)
    hashes = _mixed(np.add.reduceat(random[code[at]] * _powers()[offset & 0xFFF], starts) + lengths.astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.searchsorted(ends, at[starts], "right")


def elements(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the texts' different shingles, by text and shingle."""
    word, text = words(texts)
    n = len(word)
    sizes = np.bincount(text, minlength=len(texts))
    rare = idf[(word & np.uint64(DF_CELLS - 1)).astype(np.int64)].astype(np.float64)
    sums = np.concatenate([[0], np.cumsum(rare)])
    span = np.minimum(sizes, SHINGLE)[text]
    begin = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(n) - begin[text] + span <= sizes[text])
    shingle = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        has = span[at] > k
        shingle[has] = (shingle[has] ^ (shingle[has] >> np.uint64(31))) * _MIX + word[at[has] + k]
    shingle = _mixed(shingle)
    weight = 1 + (sums[at + span[at]] - sums[at]) / span[at]
    owner = text[at]
    order = np.lexsort((shingle, owner))
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(owner)))
    return owner[starts], shingle[starts], counts * weight[starts]


@lru_cache(maxsize=1)
def _random() -> np.ndarray:
    """r, 1 / r, beta, ln c of the ICWS draws, for each row and sample."""
    rng = np.random.default_rng(17)
    shape = (RANDOM_ROWS, BANDS * ROWS)
    r = rng.gamma(2.0, 1.0, shape)
    return np.stack([r, 1 / r, rng.random(shape), np.log(rng.gamma(2.0, 1.0, shape))], axis=1).astype(np.float32)


def band_keys(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys (n x BANDS) and sketches (n x BANDS * ROWS bytes) of texts with elements; keys of texts without any are 0."""
    random, log = _random(), np.log(weight).astype(np.float32)
    best = np.full((n, BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(owner), 4096):
        some = slice(a, a + 4096)
        r, inverse, beta, c = np.moveaxis(random[(shingle[some] >> np.uint64(40)).astype(np.int64) % RANDOM_ROWS], 1, 0)
        t = np.floor(log[some, None] * inverse + beta)
        drawn = c - r * (t - beta + 1)
        bits = drawn.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        which = (shingle[some, None].astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))).astype(np.uint64)
        starts = np.flatnonzero(np.diff(owner[some], prepend=-1))
        texts = owner[some][starts]
        best[texts] = np.minimum(best[texts], np.minimum.reduceat(ordered << np.uint64(32) | which, starts, axis=0))
    drawn = (best & np.uint64(0xFFFFFFFF)).reshape(n, BANDS, ROWS)
    key = np.full((n, BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _MIX + drawn[:, :, k])
    key[np.bincount(owner, minlength=n) == 0] = 0
    return key.view(np.int64), (_mixed(drawn) >> np.uint64(56)).astype(np.uint8).reshape(n, BANDS * ROWS)


def _cell_counts(texts: DataFrame, hashes: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """The number of texts that hold an item in each of the ``DF_CELLS`` cells of their items' hashes, and the number of texts. hashes: texts to (item, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(DF_CELLS, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.column(0).slice(i, 512).to_pylist()
                item, text = hashes(some)
                both = np.unique(text.astype(np.uint64) << np.uint64(32) | item & np.uint64(DF_CELLS - 1))
                held += np.bincount((both & np.uint64(DF_CELLS - 1)).astype(np.int64), minlength=DF_CELLS)
                n += len(some)
        if n:
            yield pa.record_batch({"slice": pa.array(range(DF_SLICES), pa.int32()), "n": pa.array([n] * DF_SLICES, pa.int64()), "held": pa.array([x.astype("<i8").tobytes() for x in np.split(held, DF_SLICES)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(k, [0, np.zeros(DF_CELLS // DF_SLICES, np.int64)])
                own[0] += n
                own[1] += np.frombuffer(held, "<i8")
        if sums:
            yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()), "n": pa.array([x[0] for x in sums.values()], pa.int64()), "held": pa.array([x[1].tobytes() for x in sums.values()], pa.binary())})

    kind = "slice int, n long, held binary"
    found = texts.select(text_or_empty().alias("text")).mapInArrow(releasing(count), kind).repartition(min(DF_SLICES, partitions(texts.sparkSession)), "slice").mapInArrow(add, kind).collect()
    held = np.concatenate([np.frombuffer(x.held, "<i8") for x in sorted(found)]) if found else np.zeros(DF_CELLS, np.int64)
    return held, found[0].n if found else 0


def _shared_array(spark: SparkSession, name: str, values: np.ndarray) -> str:
    """Writes a file of values into a new shared folder, and returns the folder."""
    folder = shared_dir(spark, name)
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(values.tobytes())
    return folder


def inverse_frequencies(texts: DataFrame) -> str:
    """Counts the documents that hold each word, over all rows of ``text``; returns the folder of the weights' file."""
    held, n = _cell_counts(texts, words)
    weights = np.log(max(n, 1) / np.maximum(held, 1)) / np.log(max(n, 2))
    return _shared_array(texts.sparkSession, "idf", weights.astype("<f4"))


def signatures(rows: DataFrame, idf: str) -> DataFrame:
    """row, doc_id, digest, bands, sketch and whole (the sum of the weights) of rows (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.asarray(open_array(idf, "idf", "<f4"))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                owner, shingle, weight = elements(some.column(3).to_pylist(), weights)
                keys, sketches = band_keys(owner, shingle, weight, some.num_rows)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                whole = np.bincount(owner, weight, some.num_rows).astype(float)
                yield pa.record_batch([*some.columns[:3], bands, pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array(whole)], names=["row", "doc_id", "digest", "bands", "sketch", "whole"])

    asked = rows.select("row", "doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), "text")
    return asked.mapInArrow(releasing(run), asked.select("row", "doc_id", "digest").schema.add("bands", T.ArrayType(T.LongType())).add("sketch", "binary").add("whole", "double"))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (sorted shingles, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def verified(pairs: DataFrame, texts: DataFrame, idf: str) -> DataFrame:
    """a, b, linked of pairs (a, b). texts: row, text of all rows in the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.asarray(open_array(idf, "idf", "<f4"))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                ids = {"a": some.column(0).to_pylist(), "b": some.column(1).to_pylist()}
                own = dict(zip(ids["a"], some.column(2).to_pylist(), strict=True)) | dict(zip(ids["b"], some.column(3).to_pylist(), strict=True))
                owner, shingle, weight = elements(list(own.values()), weights)
                bounds = np.searchsorted(owner, np.arange(len(own) + 1))
                of = {row: (shingle[s:e], weight[s:e]) for row, s, e in zip(own, bounds[:-1], bounds[1:], strict=True)}
                linked = [weighted_jaccard(of[a], of[b]) >= SIMILARITY for a, b in zip(ids["a"], ids["b"], strict=True)]
                yield pa.record_batch([some.column(0), some.column(1), pa.array(linked)], names=["a", "b", "linked"])

    both = pairs.join(texts.withColumnsRenamed({"row": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"row": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a long, b long, linked boolean")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weights and sketches allow a link. texts: row, sketch, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in batch.columns[2:4])
            x, y = (c.to_numpy() for c in batch.columns[4:6])
            fit = ((one == two).sum(axis=1) >= ALIKE) & (np.minimum(x, y) >= (SIMILARITY - 1e-5) * np.maximum(x, y))
            yield pa.record_batch([c.filter(pa.array(fit)) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda e: texts.select(*[F.col(c).alias(f"{c}_{e}") for c in ("row", "sketch", "whole")])
    both = pairs.join(side("a"), F.col("a") == F.col("row_a")).join(side("b"), F.col("b") == F.col("row_b"))
    return both.select("a", "b", "sketch_a", "sketch_b", "whole_a", "whole_b").mapInArrow(run, "a long, b long")


def _sized_groups(members: DataFrame, columns: list[str]) -> DataFrame:
    """The members of groups of two or more that have texts of their own, with n, the group's size. Sizes are combined before they are shuffled."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").drop("any_own")
    return join_hot(members, staged(sizes, "sizes"), "key", "n", max(1, members.count())).select(*columns, "n")


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds comp: the class so far."""
    if roots is None:
        return members.withColumn("comp", F.col("row"))
    return members.join(roots, members.row == roots.node, "left").withColumn("comp", F.coalesce("root", "row")).drop("node", "root")


def _open_groups(members: DataFrame) -> DataFrame:
    """The members (key, row, own, comp) of groups of several classes, with main, the class that most of the group's texts are in, n and outside.

    n is the group's size, outside the number of its texts in other classes than main.
    """
    kinds = members.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key")
    groups = kinds.agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("outside")).where("outside > 0")
    return join_hot(members.drop("n"), staged(groups, "open"), "key", "n", max(1, members.count()))


def _with_leaders(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Different pairs (a, b) of members and their groups' leaders (key, leader, size)."""
    met = join_hot(members, staged(leaders, "leaders"), "key", "size", max(1, members.count())).where("row <> leader and comp <> leader_comp")
    return met.select(F.greatest("row", "leader").alias("a"), F.least("row", "leader").alias("b")).distinct()


def _open_pairs(members: DataFrame) -> DataFrame:
    """Different pairs (a, b) of texts of different classes that share a group, one of them outside its main class at least, and one its own."""
    x = members.where("comp <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in ("row", "comp", "own")])
    y = members.select("key", *[F.col(c).alias(f"y_{c}") for c in ("row", "comp", "own")], (F.col("comp") == F.col("main")).alias("in_main"))
    met = x.join(y, "key").where("x_comp <> y_comp and (x_own or y_own) and (in_main or x_row > y_row)")
    return met.select(F.greatest("x_row", "y_row").alias("a"), F.least("x_row", "y_row").alias("b")).distinct()


BLOCK = "block long, outside boolean, in_main boolean, row long, comp long, bands array<long>, sketch binary, whole double, text string, own boolean"


def _block_links(idf: str):
    """Blocks' rows, sorted by block, to the links (a, b) between texts of different classes that join classes within a block."""

    def links(rows: list[tuple], weights: np.ndarray) -> list[tuple[int, int]]:
        xs, ys = [r for r in rows if r[1]], [r for r in rows if not r[1]]
        if not xs or not ys:
            return []
        bands = [np.array([r[5] for r in side], np.int64) for side in (xs, ys)]
        sketch = [np.frombuffer(b"".join(r[6] for r in side), np.uint8).reshape(len(side), -1) for side in (xs, ys)]
        whole, comp, row, main, own = ([np.array([r[k] for r in side]) for side in (xs, ys)] for k in (7, 4, 3, 2, 9))
        alike = np.zeros((len(xs), len(ys)), np.int32)
        for i in range(len(xs)):
            share = ((bands[0][i] == bands[1]) & (bands[1] != 0)).any(axis=1)
            near = np.minimum(whole[0][i], whole[1]) >= (SIMILARITY - 1e-5) * np.maximum(whole[0][i], whole[1])
            asked = share & near & (comp[0][i] != comp[1]) & (main[1] | (row[0][i] > row[1])) & (own[0][i] | own[1])
            alike[i] = np.where(asked, (sketch[0][i] == sketch[1]).sum(axis=1), 0)
        x, y = np.nonzero(alike >= ALIKE)
        order = np.argsort(-alike[x, y], kind="stable")
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        found, known = [], {}

        def profile(r: tuple) -> tuple[np.ndarray, np.ndarray]:
            if r[3] not in known:
                known[r[3]] = elements([r[8]], weights)[1:]
            return known[r[3]]

        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            one, two = find(xs[i][4]), find(ys[j][4])
            if one != two and weighted_jaccard(profile(xs[i]), profile(ys[j])) >= SIMILARITY:
                root[one] = two
                found.append((max(xs[i][3], ys[j][3]), min(xs[i][3], ys[j][3])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.asarray(open_array(idf, "idf", "<f4"))
        held: list[tuple] = []

        def solved() -> pa.RecordBatch:
            found = links(held, weights)
            held.clear()
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield solved()
                held.append(row)
        if held:
            yield solved()

    return run


def _in_blocks(members: DataFrame, texts: DataFrame, needed: DataFrame, idf: str) -> DataFrame:
    """Links (a, b) that join classes of open groups (key, row, own, comp, main): texts outside the main class against all, in blocks over all tasks."""
    rows = staged(members.select("key", "row", "own", "comp", "main").distinct(), "block_rows")
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ALL).alias("ny"), F.ceil(F.count_if(F.col("comp") != F.col("main")) / BLOCK_OUTSIDE).alias("nx"), F.count("*").alias("size"))
    placed = join_hot(rows, staged(sizes, "block_sizes"), "key", "size", max(1, rows.count()))
    placed = placed.join(texts, "row").join(needed, "row").withColumns({"in_main": F.col("comp") == F.col("main"), "h": F.xxhash64("row")})
    x, y = F.pmod("h", "nx"), F.pmod(F.shiftrightunsigned("h", 20), "ny")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    outside = placed.where("not in_main").withColumns({"outside": F.lit(True), "x": x, "y": F.explode(every("ny"))})
    others = placed.withColumns({"outside": F.lit(False), "y": y, "x": F.explode(every("nx"))})
    blocks = outside.unionByName(others).withColumn("block", F.xxhash64("key", "x", "y")).select(*[c.split()[0] for c in BLOCK.split(", ")])
    return blocks.repartition(partitions(members.sparkSession), "block").sortWithinPartitions("block").mapInArrow(releasing(_block_links(idf)), "a long, b long")


def _prefixes(texts: DataFrame, idf: str) -> DataFrame:
    """key, row, own of texts (row, text): the parts in which every pair with a similarity of ``SIMILARITY`` meets.

    A text's shingles are put in one order for all texts, the rarest first (by the number of these texts in the shingle's cell, then by hash). Two texts
    of weights v <= w that are similar by t share a weight of t / (1 + t) * (v + w) at least, so either holds a shared shingle among its first ones,
    up to the weight that it has beyond that; and the first of all shared shingles is among both's. Parts are keyed by that shingle and by the step
    of the lighter text's weight: a text is in the parts of its own step, and visits those of the lighter texts that it may be similar to. Only
    pairs with a text of its own need be compared. Shingles of one text alone make no part.
    """
    counts = _shared_array(texts.sparkSession, "cells", _cell_counts(texts, lambda some: elements(some, np.zeros(DF_CELLS, np.float32))[1::-1])[0].astype("<i8"))
    t = SIMILARITY - 1e-6  # room for rounding

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cells = np.asarray(open_array(idf, "idf", "<f4")), np.asarray(open_array(counts, "cells", "<i8"))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                row = some.column(0).to_numpy()
                owner, shingle, weight = elements(some.column(1).to_pylist(), weights)
                held = cells[(shingle & np.uint64(DF_CELLS - 1)).astype(np.int64)]
                order = np.lexsort((shingle, held, owner))
                owner, shingle, weight, held = owner[order], shingle[order], weight[order], held[order]
                whole = np.bincount(owner, weight, len(row))
                before = np.cumsum(weight) - weight - (np.cumsum(whole) - whole)[owner]
                step = lambda w: np.floor(np.log(np.maximum(w, 1e-9)) / np.log(WEIGHT_STEP)).astype(np.int64)
                highest, lowest = step(whole), step(whole * t)
                for down in range(int((highest - lowest).max()) + 1):
                    at = highest - down
                    least = np.maximum(WEIGHT_STEP ** at.astype(float) * (1 - 1e-9), whole * t)
                    room = np.where(at >= lowest, whole - t / (1 + t) * (whole + least), -1)
                    first = (before <= room[owner]) & (held > 1)
                    key = _mixed(_mixed(shingle[first]) + at[owner[first]].view(np.uint64) * _MIX)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(row[owner[first]]), pa.array(np.full(len(key), not down))], names=["key", "row", "own"])

    return texts.mapInArrow(releasing(run), "key long, row long, own boolean")


def linked_classes(texts: DataFrame, rows: DataFrame, idf: str) -> DataFrame | None:
    """node, root of all texts that have links; None without links.

    texts: row, bands, sketch, whole of each, a written table; rows: row, text of all documents.
    """
    needed, judged, roots = None, None, None

    def join_classes(links: DataFrame) -> None:
        nonlocal roots
        if links.isEmpty():
            return
        if roots is not None:  # classes are joined by their roots, and keep their members
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = staged(components(links), "roots")

    def compare(pairs: DataFrame) -> None:
        """Verifies pairs that aren't yet, and joins the classes of those that are links."""
        nonlocal judged
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        asked = staged(_alike(pairs, texts), "alike")
        judged = pairs if judged is None else judged.unionByName(pairs)
        join_classes(staged(verified(asked, needed, idf).where("linked").select("a", "b"), "links"))
        drop_staged(asked)

    def search(open_: DataFrame, blocks: DataFrame) -> None:
        """Compares small open groups by pairs, and blocks' groups in blocks."""
        small = open_.where(F.col("n") <= SMALL)
        if not small.isEmpty():
            compare(_open_pairs(small))
        if not blocks.isEmpty():
            join_classes(staged(_in_blocks(blocks, texts, needed, idf), "block_links"))

    exploded = texts.select("row", F.explode("bands").alias("key"), F.lit(True).alias("own")).where("key <> 0")
    members = staged(_sized_groups(exploded, ["key", "row", "own"]), "groups")
    if members.isEmpty():
        return None
    dense = staged(members.groupBy("row").agg(F.sum("n").alias("dense")), "dense")
    needed = staged(rows.join(_sized(dense), "row", "left_semi").select("row", "text"), "grouped_text")
    ranked = members.join(dense, "row")
    leaders = ranked.groupBy("key").agg(F.max_by("row", F.struct("dense", "row")).alias("leader"), F.count("*").alias("size")).withColumn("leader_comp", F.col("leader"))
    compare(_with_leaders(_labelled(members, None), leaders))
    open_ = staged(_open_groups(_labelled(members, roots)), "open_groups")
    # groups of one main class are one group in blocks, so that its texts meet once and not in every band
    search(open_, open_.where((F.col("n") > SMALL) & (F.col("outside") <= OUTSIDE)).withColumn("key", F.col("main")))
    large = open_.where((F.col("n") > SMALL) & (F.col("outside") > OUTSIDE)).select("row").distinct()
    if large.isEmpty():
        return roots
    parts = staged(_prefixes(staged(needed.join(_sized(large), "row", "left_semi"), "large_text"), idf), "parts")
    members = staged(_sized_groups(parts, ["key", "row", "own"]), "groups")
    open_ = staged(_open_groups(_labelled(members, roots)), "open_groups")
    best = F.when(F.col("own"), F.struct(F.col("comp") != F.col("main"), F.xxhash64("row", "key"), F.col("row"), F.col("comp")))
    leaders = open_.groupBy("key").agg(F.max(best).alias("best"), F.count("*").alias("size")).select("key", "size", F.col("best.row").alias("leader"), F.col("best.comp").alias("leader_comp"))
    compare(_with_leaders(open_, leaders))
    open_ = staged(_open_groups(_labelled(members, roots)), "open_groups")
    search(open_, open_.where(F.col("n") > SMALL))
    return roots


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for all nodes of edges (a, b), by large-star and small-star steps."""
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "edges")
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        drop_staged(large)
        drop_staged(edges)
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: row, doc_id, class_row (the class's smallest row)."""
    docs, row = numbered(repeatable(docs))
    rows = docs.select(F.col(row).alias("row"), F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    idf = inverse_frequencies(rows)
    signed = staged(signatures(rows, idf), "signatures")
    texts = staged(signed.groupBy("digest").agg(F.min("row").alias("text_row"), *[F.min_by(c, "row").alias(c) for c in ("bands", "sketch", "whole")], F.count("*").alias("copies")), "texts")
    roots = linked_classes(texts.select(F.col("text_row").alias("row"), "bands", "sketch", "whole"), rows, idf)
    if roots is None:
        named = texts.select("digest", "copies", F.col("text_row").alias("class_row"))
    else:
        named = texts.join(roots, texts.text_row == roots.node, "left").select("digest", "copies", F.coalesce("root", "text_row").alias("class_row"))
    return join_hot(signed.select("row", "doc_id", "digest"), named, "digest", "copies", max(1, signed.count())).select("row", "doc_id", "class_row")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs`` (the first in the scan), with all its columns."""
    docs = repeatable(docs)
    rows, row = numbered(docs)
    kept = near_classes(docs).where("row = class_row").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = staged(near_classes(table(spark, sf_dir, "documents")), "classes")
    named = classes.groupBy("class_row").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return join_hot(classes, named, "class_row", "class_size", max(1, classes.count())).select("doc_id", "class_id", "class_size")

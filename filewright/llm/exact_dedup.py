"""Exact dedup by a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z. A row's digest is the SHA-256 of the normalised text, computed in the
JVM. Every input partition first folds its own rows into a ``CuckooIndex`` (so a text that a third of all rows share leaves each partition
as one entry), entries are then hashed by digest, and each index partition folds what it gets. A filter hit is verified against the
bucketed content (full digest and byte length); a miss or a false hit inserts. The filter grows by rebuilding
from the stored keys. The row decisions come from a join with the index, in which the at most 1,000 digests that
hold over a thousandth of the rows each are broadcast and all others are shuffled.

Defined results: null text is the empty text; of equal texts the row with the largest id stays (null ids are
smallest, of repeated ids the later row); repeated rows are copies; an empty table gives no rows; other columns are
ignored. A frame that isn't a scan of Parquet files is written once, so that rows keep their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import join_hot, numbered, partitions, releasing, repeatable, staged, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that one index holds before it is emptied (map side) or split over more partitions (reduce side).
KEYS = 250_000


class CuckooIndex:
    """A cuckoo filter over live keys, with the keys and their values in content buckets, and a stash for keys that no resizing would place.

    Buckets have four 16-bit fingerprints; a key's second bucket is the first xor a hash of the fingerprint, so a fingerprint can move
    without its key. Content lies in the bucket of the key's own hash, which does not change when fingerprints move.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self._lay_out(buckets)

    def _lay_out(self, buckets: int) -> None:
        self.mask = buckets - 1
        #: hashes that found no room though the filter is nearly empty: keys that share their first eight bytes
        self.stash: dict[int, int] = {}
        self.prints = [[] for _ in range(buckets)]
        self.content: list[dict | None] = [None] * buckets
        self.turn = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        mark = (h >> 48) or 1
        first = h & self.mask
        return mark, first, (first ^ (mark * 0x5BD1E995)) & self.mask

    def get(self, key: bytes):
        """The value of a live key, or None. A filter hit is verified against the content."""
        mark, a, b = self._places(key)
        if mark not in self.prints[a] and mark not in self.prints[b] and not (self.stash and int.from_bytes(key[:8], "little") in self.stash):
            return None
        bucket = self.content[a]
        return None if bucket is None else bucket.get(key)

    def put(self, key: bytes, value) -> None:
        """Inserts a key, or replaces a live key's value."""
        mark, a, b = self._places(key)
        bucket = self.content[a]
        if bucket is None:
            bucket = self.content[a] = {}
        live = key in bucket
        bucket[key] = value
        if not live:
            self.size += 1
            if not self._insert(mark, a, b):
                self._grow() if self._is_full() else self._set_aside(key)

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        bucket = self.content[a]
        if bucket is None or key not in bucket:
            return False
        del bucket[key]
        self.size -= 1
        h = int.from_bytes(key[:8], "little")
        if h in self.stash:
            self.stash[h] -= 1
            if not self.stash[h]:
                del self.stash[h]
        else:
            self.prints[a if mark in self.prints[a] else b].remove(mark)
        return True

    def _is_full(self) -> bool:
        """Whether more buckets can help: not where a tenth of the slots is all that is used."""
        return 10 * self.size > self.SLOTS * (self.mask + 1)

    def _set_aside(self, key: bytes) -> None:
        h = int.from_bytes(key[:8], "little")
        self.stash[h] = self.stash.get(h, 0) + 1

    def items(self) -> Iterator[tuple]:
        for bucket in self.content:
            if bucket:
                yield from bucket.items()

    def _insert(self, mark: int, a: int, b: int) -> bool:
        for place in (a, b):
            if len(self.prints[place]) < self.SLOTS:
                self.prints[place].append(mark)
                return True
        place = a
        for _ in range(self.KICKS):
            self.turn = (self.turn + 1) % self.SLOTS
            held = self.prints[place]
            held[self.turn], mark = mark, held[self.turn]
            place = (place ^ (mark * 0x5BD1E995)) & self.mask
            if len(self.prints[place]) < self.SLOTS:
                self.prints[place].append(mark)
                return True
        return False

    def _grow(self) -> None:
        """Overflow: twice the buckets, filled again from the stored keys."""
        kept = list(self.items())
        while True:
            self._lay_out(2 * (self.mask + 1))
            for key, value in kept:
                mark, a, b = self._places(key)
                if self.content[a] is None:
                    self.content[a] = {}
                self.content[a][key] = value
                if not self._insert(mark, a, b):
                    if self._is_full():
                        break
                    self._set_aside(key)
            else:
                return


ENTRY = "digest binary, n_bytes long, keep_id long, keep_row long, group_size long"


def _batches(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
    rows = [(key[:32], int.from_bytes(key[32:], "little"), best[0] if best[1] else None, best[2], count) for key, (best, count) in index.items()]
    for i in range(0, len(rows), 20_000):
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 20_000], strict=True), schema.types, strict=True)], schema=schema)


def _fold(flush: bool):
    """Folds entries into an index; with ``flush``, an index of KEYS keys is handed on and begun anew. group_size 0 deletes a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            digest, n_bytes, ids, rows, sizes = (c.to_pylist() for c in batch.columns)
            for key, n, i, row, size in zip(digest, n_bytes, ids, rows, sizes, strict=True):
                key += n.to_bytes(8, "little")
                if not size:
                    index.delete(key)
                    continue
                best = (i if i is not None else -(1 << 63), i is not None, row)
                old = index.get(key)
                index.put(key, (best, size) if old is None else (max(best, old[0]), size + old[1]))
            if flush and index.size > KEYS:
                yield from _batches(index)
                index = CuckooIndex()
        yield from _batches(index)

    return run


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row (its number), doc_id, digest, n_bytes. A frame that isn't a scan is written once."""
    plain = F.translate(text_or_empty(text_column), UPPER, LOWER)
    docs, row = numbered(repeatable(docs))
    return docs.select(F.col(row).alias("row"), F.col(id_column).alias("doc_id"), F.unhex(F.sha2(F.encode(plain, "UTF-8"), 256)).alias("digest"), F.octet_length(plain).cast("long").alias("n_bytes"))


def build_index(rows: DataFrame) -> DataFrame:
    """The live digests of ``digests`` rows: digest, n_bytes, keep_id, keep_row, group_size."""
    entries = rows.select("digest", "n_bytes", F.col("doc_id").cast("long").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    spread = max(partitions(rows.sparkSession), -(-rows.count() // KEYS))
    return entries.mapInArrow(releasing(_fold(True)), ENTRY).repartition(spread, "digest").mapInArrow(releasing(_fold(False)), ENTRY)


def retire(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests (digest, n_bytes) in ``gone``; both sides meet hashed by digest, insertions first."""
    deletes = gone.select("digest", "n_bytes", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("keep_row"), F.lit(0).cast("long").alias("group_size"))
    both = index.select("digest", "n_bytes", "keep_id", "keep_row", "group_size").unionByName(deletes)
    return both.repartition(partitions(index.sparkSession), "digest").sortWithinPartitions(F.desc("group_size")).mapInArrow(releasing(_fold(False)), ENTRY)


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: row, doc_id, digest, keep_id, group_size, kept."""
    rows = staged(digests(repeatable(docs), id_column, text_column), "digests")
    index = staged(build_index(rows), "digest_index")
    found = join_hot(rows.drop("n_bytes"), index, "digest", "group_size", rows.count())
    return found.select("row", "doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = repeatable(docs)
    rows, row = numbered(docs)
    kept = exact_groups(docs, id_column, text_column).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY plain) AS kept, sha256(plain) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS plain FROM documents)
"""

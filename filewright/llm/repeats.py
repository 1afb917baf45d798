"""Suffix-array dedup: every byte covered by a 100-byte string that starts earlier is removed.

Texts are bytes; strings don't cross documents; "earlier" is by document id (nulls first, then the row), then by start. Strings are judged
on the input, and overlaps count.

1. Every 100-byte window has a least hash among its 32-byte strings, its anchor. Neighbouring windows of equal anchor make a run (69
   windows at most, 35 in the mean). Equal windows have equal anchors, so equal windows meet where anchors are dealt to buckets. A
   run travels as 30 bytes: anchor, content hash, document, start, windows.
2. In a bucket, of runs with equal content all but the first are repeats as they are. An anchor with different contents is mixed:
   its remaining runs may share some windows.
3. Mixed runs' bytes go to their anchor's bucket. There an enhanced suffix array is built over the windows that have an equal window and
   whose group's left extensions differ (or are unknown, at a run's start); a group whose left extensions agree is contained in the
   one to its left. A stack scan over the common-prefix lengths walks the interval tree: each interval of ``LENGTH`` or more is a
   maximal repeat with all its occurrences, and in each all but the first lose that many bytes.
4. Anchors with very many contents (a line that a third of all documents hold) are "hot": their windows are dealt by window hash instead,
   combined in each task first, so no bucket gathers an anchor's group.
5. Each document's removed stretches are merged and its remaining bytes hashed.

Combining before a shuffle: a task sends one run of each (anchor, content) a batch to be compared; its further copies are known to be repeats.

Defined results: null and empty texts have no bytes; texts of fewer than 100 bytes lose none; repeated rows are copies, of which the first in
the scan stays; an empty table gives no rows; other columns are ignored. A frame that isn't a scan is
written once, so that rows keep their numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import numbered, partitions, repeatable, staged, table, text_or_empty

LENGTH, GRAM = 100, 32
WINDOWS = LENGTH - GRAM + 1
FLUSH_BYTES, CHUNK_BYTES = 4_000_000, 1_000_000
#: Different contents of an anchor in one batch, or in a bucket, from which it is hot.
HOT_BATCH, HOT_BUCKET = 64, 5000
#: Columns that hold what follows a window within a run, eight bytes each.
TAIL = -(-(WINDOWS - 1) // 8)
RUN = np.dtype([("a", "<u8"), ("c", "<u8"), ("key", "<i8"), ("start", "<i4"), ("n", "u1"), ("kind", "u1")])
NORMAL, MARKER, REPEAT, HOT = range(4)
#: Added to a run's number of windows if windows of it may be equal.
SELF = 128
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _twice(x: np.ndarray, span: int) -> np.ndarray:
    """Hashes of strings of twice the span, from those of the span."""
    y = x[:-span] * _C
    y += x[span:]
    y ^= y >> np.uint64(29)
    y *= _D
    return y


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the hash of its window, its anchor's, and whether the anchor stands in the window twice."""
    h = [_BYTE[data]]
    for span in (1, 2, 4, 8, 16, 32):
        h.append(_twice(h[-1], span))
    n = len(data) - LENGTH + 1
    window = h[6][:n] * _C
    window += h[5][64 : 64 + n]
    window ^= window >> np.uint64(31)
    window *= _C
    window += h[2][96 : 96 + n]
    window ^= window >> np.uint64(29)
    window *= _D
    # the place, modulo 128, breaks ties to one side and to the other
    place = np.arange(len(h[5]), dtype=np.uint64) & np.uint64(127)
    h[5] &= ~np.uint64(127)
    first, last = _least(h[5] | place)[:n], _least(h[5] | (place ^ np.uint64(127)))[:n]
    return window, first & ~np.uint64(127), (first ^ last) & np.uint64(127) != 127


def _least(x: np.ndarray) -> np.ndarray:
    """The least of each WINDOWS neighbours."""
    span = 1
    while 2 * span <= WINDOWS:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (WINDOWS - span)], x[WINDOWS - span :])


def runs(raw: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The runs of some documents, as RUN records."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, RUN)
    window, anchor, twice = hashes(data)
    begins = np.cumsum(sizes) - sizes
    inside = np.zeros(n + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, begins[long] + sizes[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside)[:n] > 0
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first_of_doc = begins[long]
    edge[first_of_doc] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, n))
    good = inside[starts]
    starts, lengths = starts[good], lengths[good]
    parts = -(-lengths // WINDOWS)
    if parts.max(initial=1) > 1:  # long runs, as in text that repeats itself
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + lengths, parts)
        starts = np.repeat(starts, parts) + nth * WINDOWS
        lengths = np.minimum(WINDOWS, ends - starts)
    out = np.zeros(len(starts), RUN)
    doc = np.searchsorted(begins, starts, "right") - 1
    doc = np.maximum.accumulate(doc) if len(doc) else doc
    content = window[starts] * _C + (window[starts + lengths - 1] ^ lengths.astype(np.uint64))
    out["a"], out["c"], out["n"] = anchor[starts], (content ^ (content >> np.uint64(31))) * _D, lengths
    out["key"], out["start"] = keys[doc], starts - begins[doc]
    seen = np.concatenate([[0], np.cumsum(twice)])
    out["n"][seen[starts + lengths] > seen[starts]] |= SELF
    return out


def _by_content(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by anchor, content and place; where an anchor and where a content begins."""
    found = found[np.lexsort((found["start"], found["key"], found["c"], found["a"]))]
    anchor = np.ones(len(found), bool)
    anchor[1:] = found["a"][1:] != found["a"][:-1]
    content = anchor.copy()
    content[1:] |= found["c"][1:] != found["c"][:-1]
    return found, anchor, content


def _combined(found: np.ndarray) -> np.ndarray:
    """A batch's runs: copies marked REPEAT, those of hot anchors HOT with a MARKER for the anchor."""
    found, anchor, content = _by_content(found)
    found["kind"][~content] = REPEAT
    group = np.cumsum(anchor) - 1
    hot = np.bincount(group[content], minlength=int(anchor.sum())) >= HOT_BATCH
    of_hot = hot[group] & content
    markers = found[anchor][hot]
    markers["kind"] = MARKER
    found["kind"][of_hot] = HOT
    return np.concatenate([found, markers])


def _map(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            found = _combined(np.concatenate(kept))
            kept.clear()
            spread = found["kind"] >= REPEAT
            dealt = np.where(spread, found["key"].astype(np.uint64) * _C + found["start"].astype(np.uint64) * _D, found["a"]) >> np.uint64(20)
            bucket = (dealt % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, found = bucket[order], found[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.record_batch({"bucket": pa.array(bucket[first]), "runs": pa.array([x.tobytes() for x in np.split(found, first[1:])], pa.binary())})

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            begin, some = 0, []
            for i, text in enumerate(batch.column(1)):
                some.append(text.as_buffer().to_pybytes())
                size += len(some[-1])
                last = i + 1 == len(keys)
                if last or len(some) >= 256 or sum(map(len, some[-64:])) > CHUNK_BYTES:
                    kept.append(runs(some, keys[begin : i + 1]))
                    begin, some = i + 1, []
                    if size > FLUSH_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


RUNS = "key long, start int, n int, a long, kind int"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's runs to repeats (kind REPEAT), mixed runs (NORMAL) and mixed runs of hot anchors (HOT)."""
    blobs = [x.as_buffer().to_pybytes() for batch in batches for x in batch.column(1)]
    found = np.frombuffer(b"".join(blobs), RUN)
    marked = np.unique(found["a"][found["kind"] == MARKER])
    passed = found[found["kind"] >= REPEAT]
    found, anchor, content = _by_content(found[found["kind"] == NORMAL])
    group = np.cumsum(anchor) - 1
    contents = np.bincount(group[content], minlength=int(anchor.sum()))
    hot = (contents > HOT_BUCKET) | np.isin(found["a"][anchor], marked)
    sent = ~content | (contents > 1)[group] | hot[group] | (found["n"] >= SELF)
    out, kind = found[sent], np.where(~content, REPEAT, np.where(hot[group], HOT, NORMAL))[sent]
    out, kind = np.concatenate([out, passed]), np.concatenate([kind, passed["kind"]])
    for i in range(0, len(out), 50_000):
        x = out[i : i + 50_000]
        yield pa.record_batch([pa.array(x["key"].astype(np.int64)), pa.array(x["start"].astype(np.int32)), pa.array((x["n"] & (SELF - 1)).astype(np.int32)), pa.array(x["a"].astype(np.int64)), pa.array(kind[i : i + 50_000].astype(np.int32))], names=["key", "start", "n", "a", "kind"])


SENT = "a long, kind int, key long, start int, n int, seg binary"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their mixed runs to the runs' bytes, and to hot anchors' windows by hash (combined)."""
    for batch in batches:
        rows: list[tuple] = []
        windows: list[tuple[np.ndarray, ...]] = []
        for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            hot = []
            for x in found:
                if x["kind"] == HOT:
                    hot.append(x["start"] + np.arange(x["n"]))
                else:
                    rows.append((x["a"], NORMAL, key, x["start"], x["n"], raw[x["start"] : x["start"] + x["n"] + LENGTH - 1]))
            if hot:
                at = np.concatenate(hot)
                data = np.frombuffer(raw, np.uint8)
                one, two = hashes(data)[0], hashes(data ^ 0x5A)[0]
                windows.append((one[at], two[at], np.full(len(at), key, np.int64), at))
        if windows:
            one, two, key, at = map(np.concatenate, zip(*windows, strict=True))
            order = np.lexsort((at, key, two, one))
            one, two, key, at = one[order], two[order], key[order], at[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            rows += zip(one[new].view(np.int64).tolist(), [HOT] * int(new.sum()), key[new].tolist(), at[new].tolist(), [1] * int(new.sum()), [x.tobytes() for x in two[new]], strict=True)
            repeated = ~new
            order = np.lexsort((at[repeated], key[repeated]))
            key, at = key[repeated][order], at[repeated][order]
            first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1)) if len(at) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(first, len(at)))
            rows += [(int((k * 0x9E3779B1 + s) & 0x7FFFFFFF), REPEAT, int(k), int(s), int(n), None) for k, s, n in zip(key[first], at[first], lengths, strict=True)]
        for i in range(0, len(rows), 20_000):
            columns = zip(*rows[i : i + 20_000], strict=True)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["a", "kind", "key", "start", "n", "seg"])


class Repeats:
    """An enhanced suffix array over the left-diverse repeated windows of some runs, and its interval tree.

    keys, starts: each run's document and start; segments: its bytes. Two windows are compared up to the end of their runs.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, segments: list[bytes]):
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        data = np.frombuffer(b"".join(segments) + bytes(8 * (TAIL + 1) + LENGTH), np.uint8)
        begins = np.cumsum(sizes) - sizes
        counts = sizes - LENGTH + 1
        run = np.repeat(np.arange(len(segments)), counts)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[run] + offset
        window = hashes(data)[0][at]
        order = np.argsort(window)
        new = np.ones(len(order), bool)
        new[1:] = window[order][1:] != window[order][:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        # left extensions: the byte before, or one of its own at a run's start
        left = np.where(offset > 0, data[at - 1].astype(np.int64), 256 + np.arange(len(at)))
        low, high = np.full(int(new.sum()), 1 << 60), np.full(int(new.sum()), -1)
        np.minimum.at(low, group, left)
        np.maximum.at(high, group, left)
        many = np.bincount(group) > 1
        chosen = np.flatnonzero((many & (low != high))[group])
        at, run, offset, group, left = at[chosen], run[chosen], offset[chosen], group[chosen], left[chosen]
        rest = (sizes[run] - offset - LENGTH).astype(np.int64)  # bytes of the run after the window
        tail = np.zeros((TAIL, len(at)), np.uint64)
        for k in range(TAIL):
            word = np.zeros(len(at), np.uint64)
            for b in range(8):
                byte = np.where(8 * k + b < rest, data[at + LENGTH + 8 * k + b].astype(np.uint64), np.uint64(0))
                word = word << np.uint64(8) | byte
            tail[k] = word
        order = np.lexsort((*tail[::-1], group))
        self.key, self.start, self.left = keys[run][order], (starts[run] + offset)[order], left[order]
        rest, group, tail = rest[order], group[order], tail[:, order]
        # common prefixes of neighbours: 0 between groups, else LENGTH and what their tails share
        same = tail[:, 1:] ^ tail[:, :-1]
        common = np.zeros(max(0, len(order) - 1), np.int64)
        open_ = np.ones(len(common), bool)
        for k in range(TAIL):
            zero = same[k] == 0
            shared = np.where(zero, 8, (same[k].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1))
            common += np.where(open_, shared, 0)
            open_ &= zero
        common = np.minimum(common, np.minimum(rest[1:], rest[:-1]) if len(common) else common)
        self.common = np.where(group[1:] == group[:-1], LENGTH + common, 0)

    def removed(self) -> list[tuple[int, int, int]]:
        """(document, start, length) of what each suffix loses: the longest interval in which an occurrence is earlier."""
        return [x for x, _ in self._scan(False)]

    def groups(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """(length, all occurrences) of the left-diverse intervals: the maximal repeats."""
        return [x for _, x in self._scan(True)]

    def _scan(self, members: bool):
        place = list(zip(self.key.tolist(), self.start.tolist(), strict=True))
        left, common = self.left.tolist(), [*self.common.tolist(), 0]
        #: open intervals: common length, first index, earliest place
        stack: list[list] = []
        for i, at in enumerate(place):
            begin, least = i, at
            follows = common[i]
            while stack and stack[-1][0] > follows:
                length, begin, earliest = stack.pop()
                # the last child of the closing interval meets its siblings
                if not members:
                    yield (*max(least, earliest), length), None
                least = min(least, earliest)
                if members and len(set(left[begin : i + 1])) > 1:
                    yield None, (length, place[begin : i + 1])
            if follows:
                if stack and stack[-1][0] == follows:
                    if not members:
                        yield (*max(least, stack[-1][2]), follows), None
                    stack[-1][2] = min(least, stack[-1][2])
                else:
                    stack.append([follows, begin, least])


SPANS = "key long, start int, length int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sent runs and windows, sorted by (a, kind, seg, key, start), to removed stretches."""
    chunk: list[tuple] = []
    size, last, hot = 0, None, None
    out: list[tuple] = []

    def resolve() -> None:
        key, start, segments = zip(*chunk, strict=True)
        out.extend(Repeats(np.array(key), np.array(start), list(segments)).removed())
        chunk.clear()

    def batch_of() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((), (), ())
        made = pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "start", "length"])
        out.clear()
        return made

    for batch in batches:
        for a, kind, key, start, n, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == REPEAT:
                out.append((key, start, n + LENGTH - 1))
            elif kind == HOT:
                if (a, seg) == hot:
                    out.append((key, start, LENGTH))
                hot = (a, seg)
            else:
                if a != last and size > CHUNK_BYTES:
                    resolve()
                    size = 0
                chunk.append((key, start, seg))
                size += len(seg)
                last = a
        if len(out) > 50_000:
            yield batch_of()
    if chunk:
        resolve()
    yield batch_of()


RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their removed stretches to what is left of them."""
    for batch in batches:
        rows = []
        for text, starts, lengths in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = text.as_buffer().to_pybytes()
            spans = merged(starts.values.to_numpy(), lengths.values.to_numpy()) if starts.is_valid and len(starts) else np.zeros((0, 2), np.int64)
            digest, at = hashlib.sha256(), 0
            for a, b in spans.tolist():
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(begin, end) of the maximal stretches that some stretches cover."""
    order = np.argsort(starts)
    a, b = starts[order].astype(np.int64), (starts + lengths)[order].astype(np.int64)
    b = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return np.stack([a[first], b[np.append(first[1:], len(a)) - 1]], axis=1)


def _ordered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """key (the place in the order of documents), doc_id, text; whether the key is the id itself, as where ids are unique and not null."""
    docs = repeatable(docs)
    own = [F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text")]
    ids = docs.select(own[0]).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        return docs.select(own[0].alias("key"), *own), True
    docs, row = numbered(docs)
    rows = docs.select(F.col(row).alias("row"), *own)
    narrow = rows.select("doc_id", "row").repartitionByRange(partitions(docs.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    narrow = staged(narrow.withColumn("key", F.monotonically_increasing_id()), "keys")
    return rows.drop("doc_id").join(narrow, "row").select("key", "doc_id", "text"), False


def removed_stretches(rows: DataFrame) -> DataFrame:
    """key, starts, lengths of the removed stretches (they may overlap) of rows (key, text)."""
    spark = rows.sparkSession
    buckets = partitions(spark)
    sent = rows.select("key", "text").mapInArrow(_map(buckets), "bucket int, runs binary")
    judged = staged(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_judge, RUNS), "runs")
    mixed = judged.where(F.col("kind") != REPEAT).groupBy("key").agg(F.collect_list(F.struct("start", "n", "a", "kind")).alias("runs"))
    bytes_of = rows.select("key", "text").join(mixed, "key").select("key", "text", "runs").mapInArrow(_send, SENT)
    compared = bytes_of.repartition(buckets, "a").sortWithinPartitions("a", "kind", "seg", "key", "start").mapInArrow(_compare, SPANS)
    spans = judged.where(F.col("kind") == REPEAT).select("key", "start", (F.col("n") + (LENGTH - 1)).alias("length")).unionByName(staged(compared, "spans"))
    return spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows, by_id = _ordered(docs, id_column, text_column)
    spans = removed_stretches(rows.select("key", "text"))
    cut = rows.select("key", "text").join(spans, "key", "left").select("key", "text", "starts", "lengths").mapInArrow(_cut, RESULT)
    if by_id:
        return cut.withColumnRenamed("key", "doc_id")
    return cut.join(rows.select("key", "doc_id"), "key").drop("key")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. The pieces' lengths are counted (a number for each of ``capacity``
lengths is all that the driver sees), and best-fit decreasing runs over these counts: of a length with a million pieces, all that fit into
a million equal sequences are placed in one step. The plan says, for each length, how many slots stand at which place of which sequences. Pieces then
take planned slots by their rank within their length, met by a join on length and a range of ranks.

Ranks come from numbers that the encoding tasks count for each length, written with the pieces, plus prefix sums over the tasks: no sort, and a length
that a third of all pieces have is spread over all tasks. The plan is broadcast: each length adds at most four kinds of
sequences, each with at most sqrt(2 x capacity) different lengths, so it has at most 4 x capacity x sqrt(2 x capacity) rows whatever the input (524,288 at 2,048), and
in practice a few thousand.

Defined results: null text is an empty document (only the end id); only documents longer than ``capacity`` are cut; repeated ids and
rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.llm.common import releasing, staged, table, text_or_empty
from filewright.llm.token_files import ByteBpe

PIECE = "part int, length int, nth long, doc_id long, piece int, start long, ids_crc32 long"
PLAN = "length int, first long, slots long, each long, sequence long, at long"


class WordBpe(ByteBpe):
    """Encodes with a ``tokenizers`` file of BPE with word ends: lower-cased, white space dropped.

    As ``ByteBpe``, it cuts Latin-1 text by the file's own published pattern (such text has no other normal form, and its lower case is character by character)
    and keeps words' ids in a bounded memo; other texts go to the library whole.
    """

    CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{ByteBpe.LETTER}]+|[0-9]|[^{ByteBpe.LETTER}0-9{ByteBpe.SPACE}]+").findall

    def cut(self, text: str) -> list[str]:
        return self.CUT(text.lower())


@lru_cache(maxsize=1)
def word_bpe(path: str, end_id: int) -> WordBpe:
    """One encoder a worker process, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordBpe(path, end_id)


#: Characters of texts that are encoded at a time, and of slices that a longer text is encoded in.
CHARS = 1 << 20
BREAK = re.compile(r"[ \n]")


def slices(text: str) -> list[str]:
    """A long text in slices that begin with a space or a line's end: no word, and no normal form, crosses these."""
    out, at = [], 0
    while len(text) - at > CHARS:
        m = BREAK.search(text, at + CHARS)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encoded(texts: Iterator[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Each text's ids, the end id last. Texts are encoded together up to CHARS characters, long ones slice by slice."""

    def some() -> Iterator[np.ndarray]:
        ids, lengths = encode(held)
        return iter(np.split(ids, np.cumsum(lengths)[:-1]))

    held, size = [], 0
    for text in texts:
        if len(text) > CHARS:
            if held:
                yield from some()
                held, size = [], 0
            # without the end id that each slice gets
            parts = [encode([part])[0].astype(np.uint32) for part in slices(text)]
            yield np.concatenate([*(p[:-1] for p in parts), parts[-1][-1:]])
            continue
        held.append(text)
        size += len(text)
        if size > CHARS:
            yield from some()
            held, size = [], 0
    if held:
        yield from some()


def pieces(docs: DataFrame, encoder: Callable[[], Callable], capacity: int, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: part and nth (the piece's number among those of its length in this part), length, doc_id, piece, start, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own in enumerate(encoded((x.as_py() for x in batch.column(1)), encode)):
                own = own.astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    some = own[at : at + capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(some))
                    crc.append(zlib.crc32(some))
                    if with_ids:
                        ids.append(some)
            lengths = np.array(length, np.int64)
            order = np.argsort(lengths, kind="stable")
            firsts = np.searchsorted(lengths[order], lengths[order])
            nth = np.empty(len(lengths), np.int64)
            nth[order] = seen[lengths[order]] + np.arange(len(lengths)) - firsts
            seen += np.bincount(lengths, minlength=capacity + 1)
            columns = [pa.array(np.full(len(length), part, np.int32)), pa.array(length, pa.int32()), pa.array(nth), batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(crc, pa.int64())]
            names = ["part", "length", "nth", "doc_id", "piece", "start", "ids_crc32"]
            yield pa.record_batch([*columns, pa.array(ids, pa.list_(pa.int64()))] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(releasing(run), PIECE + (", ids array<long>" if with_ids else ""))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows of (length, first, slots, each, sequence, at).

    Of pieces of a length, those with rank ``first`` to ``first + slots - 1`` lie ``each`` by ``each``, from place ``at`` on, in the sequences from ``sequence`` on.
    """
    #: kinds of sequences by the room they have left: (how many, [(length, how many of it in each), ...])
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        new: list[tuple[int, int, list]] = []

        def fill(n: int, slots: list, free: int, new: list = new, length: int = length) -> int:
            """Fills as many of ``n`` equal sequences as pieces are left; returns how many pieces they take."""
            k = free // length
            full = min(n, left // k)
            rest = min(left - full * k, k) if full < n else 0
            new.extend((m, free - j * length, [*slots, (length, j)]) for m, j in ((full, k), (min(1, rest), rest)) if m and j)
            if n - full - min(1, rest):
                new.append((n - full - min(1, rest), free, slots))
            return full * k + rest

        for free in range(length, capacity + 1):
            if not left:
                break
            kinds, room[free] = room[free], []
            for n, slots in kinds:
                if left:
                    left -= fill(n, slots, free)
                else:
                    new.append((n, free, slots))
        if left:
            left -= fill(-(-left // (capacity // length)), [], capacity)
        for n, free, slots in new:
            room[free].append((n, slots))
    plan, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for free in range(capacity + 1):
        for n, slots in room[free]:
            at = 0
            for length, each in slots:
                plan.append((length, taken[length], n * each, each, sequence, at))
                taken[length] += n * each
                at += length * each
            sequence += n
    return plan


def packed(docs: DataFrame, encoder: Callable[[], Callable], capacity: int, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece of ``docs``."""
    spark = docs.sparkSession
    rows = staged(pieces(docs, encoder, capacity, id_column, text_column, with_ids), "pieces")
    counts = staged(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    plan = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    slots = F.broadcast(spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "slot_length"))
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("slots"))
    placed = ranked.join(slots, here).withColumn("k", F.col("rank") - F.col("first"))
    sequence, offset = F.col("sequence") + F.floor(F.col("k") / F.col("each")), F.col("at") + (F.col("k") % F.col("each")) * F.col("length")
    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset")]
    return placed.select(*columns, *(["ids"] if with_ids else []))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and the sequence's ids, from ``packed`` rows with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), partial(word_bpe, public_tokenizers.path("word_bpe_49k.json"), 0), 2048)

"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read by memory map.

Layout of a folder:

* ``NAME.ids``         token ids, little-endian, ``id_bytes`` wide (2 where the vocabulary fits, else 4)
* ``OFFSETS.offsets``  uint64: start of each document in the whole corpus, then the end of the last
* ``NAME.docs``        int64: the documents' ids, and one byte each (1: the id is null) in ``NAME.nulls``
* ``index.json``       id width, end-of-document id, parts in order with their names, offsets and bases

Documents are range-partitioned and sorted by id, so the parts in order hold the ids ascending (nulls first). Each attempt of a task
writes under a name of its own, nothing is renamed, and the index lists the attempts that counted: a task that runs again leaves files that the
index doesn't name.
Bases are prefix sums over the parts' totals (one row a part reaches the driver). Each task streams its
documents; it holds one Arrow batch and eight bytes a document.

Defined results: null text is an empty document (only the end id); repeated ids follow each other; an empty table
gives an index without parts; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import filesystem, partitions, shared_dir, table, text_or_empty


class _Numbers(dict):
    """Numbers strings as they come and lists those that are new."""

    def __init__(self):
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, key) -> int:
        self[key] = number = self.next
        self.next += 1
        self.new.append(key)
        return number


class ByteBpe:
    """Encodes with a ``tokenizers`` file of byte-level BPE; ids of pre-tokens seen before come from a bounded memo.

    A pre-token's ids don't depend on its neighbours, so texts are cut into pre-tokens by the file's own published
    pattern, written here for Latin-1 text without superscripts, fractions and separator controls: ``LETTER`` is its
    ``\\p{L}``, ``SPACE`` its ``\\s``. Any other text goes to the library whole, and so does one that holds an added token's string
    (``<|endoftext|>``), which the library takes for that token.
    """

    LETTER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\t-\r \x85\xa0"
    CUT = re.compile(rf" ?[{LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{LETTER}0-9{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
    ODD = bytes([*range(0x1C, 0x20), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])

    def __init__(self, path: str, end_id: int, memo: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit, self.end_id = memo, end_id
        self.numbers = _Numbers()
        #: ids of all numbered strings, end to end, and where each begins; number 0 is the end of a document
        self.ids, self.starts = np.array([end_id], np.uint32), np.array([0, 1])
        self.numbers[None] = 0
        self.numbers.next = 1

    def _plain(self, text: str) -> bool:
        if any(x in text for x in self.added):
            return False
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, self.ODD)) == len(raw)

    def cut(self, text: str) -> list[str]:
        return self.CUT(text)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts, each followed by the end id, end to end; and the number of ids of each."""
        pieces: list = []
        for text in texts:
            if self._plain(text):
                pieces += self.cut(text)
            else:
                pieces.append((text,))
            pieces.append(None)
        frozen = len(self.starts) - 1
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if new := self.numbers.new:
            strings = [x for x in new if isinstance(x, str)]
            found = iter([e.ids for i in range(0, len(strings), 8192) for e in self.pieces.encode_batch_fast(strings[i : i + 8192], add_special_tokens=False)])
            lists = [next(found) if isinstance(x, str) else self.whole.encode(x[0], add_special_tokens=False).ids for x in new]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
        sizes = np.diff(self.starts)[numbers]
        ends = np.cumsum(sizes)
        out = self.ids[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        lengths = np.diff(np.concatenate([[0], ends[numbers == 0]]))
        drop = new if frozen >= self.limit else [x for x in new if not isinstance(x, str)] and new
        if drop:  # a full memo stays as it is, and whole texts aren't kept
            for x in new:
                del self.numbers[x]
            self.starts = self.starts[: frozen + 1]
            self.ids = self.ids[: self.starts[-1]]
            self.numbers.next = frozen
        self.numbers.new = []
        return out, lengths


@lru_cache(maxsize=1)
def byte_bpe(path: str, end_id: int) -> ByteBpe:
    """One encoder a worker process, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path, end_id)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


#: Characters of texts that are encoded at a time (or one text).
CHARS = 1 << 20


def together(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, 256 at most and CHARS characters (or one text) at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1])
        if size > CHARS or len(some) == 256:
            yield some
            some, size = [], 0
    if some:
        yield some


def write_token_files(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], vocabulary: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """Encodes and writes all documents; returns the index, also written as ``index.json``.

    encoder: makes, on the executor, the function from texts to their ids, end ids included, and the ids' numbers.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    # the hash and the row number split an id that very many rows share
    rows = rows.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{part:05d}-{context.taskAttemptId()}"
        own = f"{path}/{name}"
        encode, ids, nulls, sizes = encoder(), [], [], []
        with store.open_output_stream(f"{own}.ids") as out:
            for batch in batches:
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                texts = batch.column(1)
                for some in together(texts):
                    found, lengths = encode(some)
                    sizes.append(lengths)
                    out.write(found.astype(f"<u{width}").tobytes())
        if not sizes:
            store.delete_file(f"{own}.ids")
            return
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        for kind, data in (("local", ends), ("docs", np.concatenate(ids).astype("<i8")), ("nulls", np.concatenate(nulls).astype("u1"))):
            with store.open_output_stream(f"{own}.{kind}") as out:
                out.write(data.tobytes())
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "name": pa.array([name]), "docs": pa.array([len(ends) - 1], pa.int64()), "ids": pa.array([int(ends[-1])], pa.int64())})

    parts = sorted(rows.mapInArrow(write, "part int, name string, docs long, ids long").collect())
    start = doc = 0
    index = {"id_bytes": width, "end_id": end_id, "parts": []}
    for part, name, n_docs, n_ids in parts:
        index["parts"].append({"part": part, "name": name, "first_doc": doc, "docs": n_docs, "start": start, "ids": n_ids})
        doc, start = doc + n_docs, start + n_ids

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for batch in batches:
            names = []
            for name, base in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}.local") as f:
                    offsets = np.frombuffer(f.read(), "<u8") + np.uint64(base)
                names.append(f"{name}-{TaskContext.get().taskAttemptId()}")
                with store.open_output_stream(f"{path}/{names[-1]}.offsets") as out:
                    out.write(offsets.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string())], names=["part", "offsets"])

    if parts:
        offsets = dict(_parts(spark, index).mapInArrow(number, "part int, offsets string").collect())
        for p in index["parts"]:
            p["offsets"] = offsets[p["part"]]
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def _parts(spark: SparkSession, index: dict) -> DataFrame:
    rows = [(p["part"], p["name"], p.get("offsets"), p["start"]) for p in index["parts"]]
    return spark.createDataFrame(rows, "part int, name string, offsets string, start long").repartitionById(max(1, len(rows)), F.col("part") % max(1, len(rows)))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (of ids as uint32), part."""
    store, path = filesystem(folder)
    with store.open_input_file(f"{path}/index.json") as f:
        index = json.loads(f.read())
    width = index["id_bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name, numbers, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, docs, nulls = (open_array(folder, f"{name}.{kind}", t) for kind, t in (("ids", f"<u{width}"), ("docs", "<i8"), ("nulls", "u1")))
                starts = open_array(folder, f"{numbers}.offsets", "<u8").astype(np.int64)
                for at in range(0, len(docs), 20_000):
                    some = slice(at, min(at + 20_000, len(docs)))
                    bounds = starts[at : some.stop + 1] - base
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.record_batch({
                        "doc_id": pa.array(docs[some], pa.int64(), mask=np.asarray(nulls[some], bool)),
                        "start": pa.array(starts[some], pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "part": pa.array([part] * len(crc), pa.int32()),
                    })

    return _parts(spark, index).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def open_array(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file of the folder as an array: a memory map where the folder is local, else read."""
    from pyarrow import fs

    store, path = filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_dir(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), folder, partial(byte_bpe, path, 0), vocabulary_size(path))
    return read_token_files(spark, folder)

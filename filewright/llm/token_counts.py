"""Token counts in delta-maintained rollups by source, language and tokenizer version.

A batch is a set of signed rows: an insert adds a document's count, a delete takes it away, a revised count is both. A commit sums
a batch to additive deltas a (source, lang, tokenizer), writes them, and then moves a mark into place that names these deltas as the batch's.
A batch that has its mark is left alone, so a batch that is sent again (or whose driver died
after the move) counts once. Totals are sums over the marked deltas; a fold sums old batches into a base, and totals are then that and later batches.

Rows are summed before they are shuffled, so a source with a third of all rows is one row a task. What is kept
grows with the number of (source, lang, tokenizer) and with batches' names, not with documents.

Defined results: null and empty texts count 0 tokens and one document; null source or language is a group of its own; a document
inserted twice counts twice; an empty batch commits and changes nothing; groups whose documents are all deleted
vanish; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import drop_staged, shared_dir, slices, staged, table, text_or_empty

DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
GROUP = ["source", "lang", "tokenizer"]
#: Bytes of texts that are counted together.
TEXT_BYTES = 1 << 22


class TokenLedger:
    """A folder of deltas (``deltas``, a folder for each attempt), of marks that name the attempt a batch stands for (``committed``), and of bases.

    A base is the sum of many batches and the list of their names. Marks are small files, moved into place whole; a second mark of a batch is refused or takes the
    first one's place, and either way one attempt of the batch counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("deltas", "committed", "bases"):
            self._fs.mkdirs(self._path(f"{self.folder}/{name}"))

    def _mark(self, batch_id: str):
        return self._path(f"{self.folder}/committed/batch-{base64.urlsafe_b64encode(batch_id.encode()).decode()}")

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._mark(batch_id))

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """signed: source, lang, tokenizer, tokens, sign (+1 insert, -1 delete). False if the batch was there already."""
        if self.committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        deltas = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        deltas.write.parquet(f"{self.folder}/deltas/attempt={attempt}")
        if self._publish(self._mark(batch_id), attempt):
            return True
        self._fs.delete(self._path(f"{self.folder}/deltas/attempt={attempt}"), True)
        return False

    def _publish(self, target, text: str) -> bool:
        """Puts a file with this text into place; False if there is one."""
        own = self._path(f"{self.folder}/open/{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.exists(target) and self._fs.rename(own, target):
            return True
        self._fs.delete(own, False)
        return False

    def _generations(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/bases"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _base(self) -> tuple[int, str]:
        """The latest base's number and folder; 0 and none before the first."""
        generations = self._generations()
        if not generations:
            return 0, ""
        name = self.spark.read.text(f"{self.folder}/bases/{generations[-1]}").first()[0]
        return generations[-1], f"{self.folder}/sums/{name}"

    def _sums(self, base: str) -> tuple[DataFrame, DataFrame]:
        """All totals (zeros too), and the batches (name, attempt) in them that the base hasn't got."""
        marks = self.spark.read.text(f"{self.folder}/committed")
        marks = marks.select(F.col("_metadata.file_name").alias("batch"), F.col("value").alias("attempt"))
        if base:
            marks = marks.join(self.spark.read.schema("batch string").parquet(f"{base}/batches"), "batch", "left_anti")
        deltas = self.spark.read.schema(DELTA + ", attempt string").parquet(f"{self.folder}/deltas").join(marks, "attempt", "left_semi").drop("attempt")
        if base:
            deltas = deltas.unionByName(self.spark.read.schema(DELTA).parquet(f"{base}/totals"))
        return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), marks

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        sums, _ = self._sums(self._base()[1])
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def fold(self) -> bool:
        """Sums all batches committed so far into a base, so that totals read it and later batches alone. False if another fold came first.

        The files of batches that the base before had already are deleted; readers of that base may still be at work on the others.
        """
        generation, old = self._base()
        own = uuid.uuid4().hex
        new = f"{self.folder}/sums/{own}"
        # the names are written first: the sums are of these batches, whatever is committed meanwhile
        marks = self._sums(old)[1]
        marks.write.parquet(f"{new}/added")
        added = self.spark.read.schema("batch string, attempt string").parquet(f"{new}/added")
        batches = added.select("batch")
        deltas = self.spark.read.schema(DELTA + ", attempt string").parquet(f"{self.folder}/deltas").join(added, "attempt", "left_semi").drop("attempt")
        if old:
            batches = batches.unionByName(self.spark.read.schema("batch string").parquet(f"{old}/batches"))
            deltas = deltas.unionByName(self.spark.read.schema(DELTA).parquet(f"{old}/totals"))
        batches.write.parquet(f"{new}/batches")
        sums = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where((F.col("docs") != 0) | (F.col("tokens") != 0)).write.parquet(f"{new}/totals")
        if not self._publish(self._path(f"{self.folder}/bases/{generation + 1}"), own):
            self._fs.delete(self._path(new), True)
            return False
        if old:
            for row in self.spark.read.schema("batch string, attempt string").parquet(f"{old}/added").select("attempt").toLocalIterator():
                self._fs.delete(self._path(f"{self.folder}/deltas/attempt={row[0]}"), True)
        return True


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str):
    """The counting function of a byte-level BPE given as ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]


@lru_cache(maxsize=4)
def pieces(path: str):
    """The counting function of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, tokenizers: dict[str, Callable[[], Callable[[list[str]], list[int]]]]) -> DataFrame:
    """source, lang and a column of counts for each tokenizer version; texts are read once for all.

    tokenizers: by version, what makes on the executor the function from texts to their numbers of tokens.
    """
    schema = pa.schema([("source", pa.string()), ("lang", pa.string()), *((name, pa.int64()) for name in tokenizers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [make() for make in tokenizers.values()]
        for batch in batches:
            for some in slices(batch, 2, 256, TEXT_BYTES):
                texts = some.column(2).to_pylist()
                yield pa.record_batch([*some.columns[:2], *(pa.array(c(texts), pa.int64()) for c in count)], schema=schema)

    kind = "source string, lang string, " + ", ".join(f"`{name}` long" for name in tokenizers)
    return docs.select("source", "lang", text_or_empty().alias("text")).mapInArrow(run, kind)


def signed(counts: DataFrame, tokenizer: str, sign: int = 1) -> DataFrame:
    """The rows of ``token_counts`` under one version, inserted or (-1) deleted."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("tokens"), F.lit(sign).alias("sign"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents under two tokenizer versions, revises one to a third, folds the batches, sends each again, and returns the totals."""
    import public_tokenizers as public

    versions = {name: partial(byte_bpe, public.path(f"{name}.tiktoken"), public.PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    versions["piece_bpe_32k"] = partial(pieces, public.path("piece_bpe_32k.model"))
    counts = staged(token_counts(table(spark, sf_dir, "documents"), versions), "token_counts")
    ledger = TokenLedger(spark, shared_dir(spark, "ledger"))
    batches = {
        "insert byte_bpe_50k": signed(counts, "byte_bpe_50k"),
        "insert piece_bpe_32k": signed(counts, "piece_bpe_32k"),
        "revise byte_bpe_50k to byte_bpe_multi_50k": signed(counts, "byte_bpe_50k", -1).unionByName(signed(counts, "byte_bpe_multi_50k")),
    }
    for _ in range(2):
        for name, rows in batches.items():
            ledger.commit(name, rows)
        ledger.fold()
    drop_staged(counts)
    return ledger.totals()

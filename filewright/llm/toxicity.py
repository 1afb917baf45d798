"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model give the probability of each character of a word from up to ``ORDER`` characters before it (the word's start
is one of them). Full histories are counted for each class (documents that hold the word). Where a history or what follows it is
rare, both models back off to the same counts of both classes together, and these to shared lower orders of continuation
counts (in how many different left contexts a string was seen). The classes' own counts are interpolated as in Kneser-Ney with a
discount and, as in its Pitman-Yor form, ``STRENGTH`` counts of backoff.

Toxic texts are mostly ordinary words, so the toxic likelihood of a text lets each word be toxic with probability ``SHARE``: its evidence is the
sum over all its words, each as often as it stands there, of log((1 - SHARE) P(word | ordinary) + SHARE P(word | toxic)) - log P(word | ordinary),
normalised by the number of words n (a mean, and a sum over the root of n, the spread of chance). A logistic curve
turns the two normalised values into a score between 0 and 1. The toxic model is fitted to that mixture by ``ROUNDS`` rounds of expectation
maximisation: a word of toxic documents counts with the probability that it is toxic under the model of the round before.

Counts cover every labelled row outside the held-out part and are keyed by the words and n-grams themselves. They, the backoff chain and the
probabilities are DataFrame work; executors write the tables as slices of sorted 64-bit keys, which grow with the
labelled corpus and are memory-mapped by the workers. The driver sees numbers of labels and, for the curve alone,
the evidence of at most ``CURVE_ROWS`` ids of one fold, the first by hash (rows of one id count as their mean), scored by a trial model of the other folds. Trial and final model are worked
out together, as columns side by side.

Two tables make a model. One is of both classes: of a seen n-gram its ordinary and its pooled probability, of a seen history the ordinary
share of backoff. The other is of the toxic class: n-grams' probabilities and histories' shares. Of an n-gram that neither class has
seen, the backoff terms cancel.

Words of any length are taken in pieces that carry their histories along, so memory depends on ``CHARS``, not on the longest word.

Defined results: null and empty texts (no words) have the score of zero evidence; a null id is not held out and has no
label; several labels of one id count as toxic if one says so; without labels of both kinds every score is 0; without a fold that can be left
out for the curve (both kinds in it and beside it) the curve is ``FIXED_CURVE``; repeated rows are scored
alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from filewright.llm.common import drop_staged, filesystem, releasing, shared_dir, slices, staged, table, text_or_empty, unused
from filewright.llm.token_files import open_array

#: Characters of history; a full n-gram has one more.
ORDER = 6
DISCOUNT, STRENGTH, SHARE = 0.75, 20.0, 0.01
#: Rounds that refit the toxic model to the mixture.
ROUNDS = 3
CURVE_ROWS, HELD_OUT = 20_000, 2
#: Folds that may be left out for the curve, the first that can be first.
CURVE_FOLDS = (3, 1, 0)
#: Constant, mean and scaled sum of the curve where none can be fitted: zero evidence scores 0.12.
FIXED_CURVE = (-2.0, 1.0, 0.5)
#: Labels are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_LABELS = 2_000_000
#: Rows of a model slice; different words that a counting task, a scorer's memo and a step over n-grams hold; texts that are scored together.
SLICE_ROWS, COUNTED, MEMO, STEP, TEXTS = 1_000_000, 250_000, 200_000, 10_000, 256
#: Characters of a step over n-grams, into which longer words are cut; of the words that a counting task or a memo holds; bytes of texts that are scored together.
CHARS, HELD_CHARS, TEXT_BYTES = 1 << 18, 1 << 23, 1 << 22
THRESHOLD = 0.3
#: Marks of a word's start and end, and of a name that is a history.
START, END, PAST = "\x02", "\x03", "\x01"
WORD = re.compile(r"\w+").findall
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_PAST = np.uint64(0xA5A5A5A5A5A5A5A5)


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of all but their last characters (code points)."""
    return (h ^ (h >> np.uint64(29))) * _BASE + (code + np.uint64(1)) * _MIX


def _key(h: np.ndarray, length) -> np.ndarray:
    h = (h + np.asarray(length, np.uint64)) * _MIX
    return (h ^ (h >> np.uint64(32))) * _BASE


def keys_of(strings: list[str]) -> np.ndarray:
    """The keys of n-grams, and of histories (after ``PAST``), as ``Grams`` works them out."""
    past = np.fromiter((x[0] == PAST for x in strings), bool, len(strings))
    strings = [x.removeprefix(PAST) for x in strings]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros(len(strings), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        code = np.frombuffer("".join([strings[i] for i in at]).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, size)
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = _longer(h, code[:, k])
        out[at] = _key(h, size)
    return np.where(past, out ^ _PAST, out)


class Grams:
    """The n-grams of some words, one for each character and for the word's end: the keys of it and its history, and its word.

    whole: the words' characters, each word between its marks; offset: each one's place in its word (a start's is 0); of: its word. The first ``past`` characters
    are history alone.
    """

    def __init__(self, whole: str, offset: np.ndarray, of: np.ndarray, past: int = 0):
        self.whole = whole
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64)
        self.at = past + np.flatnonzero(offset[past:] > 0)
        self.word = of[self.at]
        #: characters of each history
        self.back = np.minimum(offset[self.at], ORDER)
        h, history = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint64)
        for k in range(ORDER, -1, -1):
            in_ = self.back >= k
            h[in_] = _longer(h[in_], code[self.at[in_] - k])
            if k == 1:
                history[:] = h
        self.gram, self.history = _key(h, self.back + 1), _key(history, self.back) ^ _PAST

    @classmethod
    def steps(cls, words: list[str]) -> Iterator[Grams]:
        """All words' n-grams in steps of bounded size; a word of more than ``CHARS`` characters is cut, and each piece begins with its first n-gram's history."""
        first, size = 0, 0
        for i, word in enumerate(words):
            long = len(word) + 2 > CHARS
            if first < i and (long or size + len(word) + 2 > CHARS or i - first == STEP):
                yield cls._of(words, first, i)
                first, size = i, 0
            size += len(word) + 2
            if long:
                whole = START + word + END
                for a in range(0, len(whole), CHARS):
                    past = min(a, ORDER)
                    piece = whole[a - past : a + CHARS]
                    yield cls(piece, np.arange(a - past, a - past + len(piece)), np.full(len(piece), i), past)
                first, size = i + 1, 0
        if first < len(words):
            yield cls._of(words, first, len(words))

    @classmethod
    def _of(cls, words: list[str], first: int, end: int) -> Grams:
        some = words[first:end]
        sizes = np.fromiter(map(len, some), np.int64, len(some)) + 2
        return cls(START + (END + START).join(some) + END, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(first, end), sizes))

    def name(self, i: int) -> str:
        end = self.at[i] + 1
        return self.whole[end - self.back[i] - 1 : end]


COUNTS = ("n0", "n1", "m0", "m1")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled rows (text, toxic, curve) to documents by word and class: n of all, m of those outside the curve's fold."""
    held: list[dict[str, int]] = [{}, {}, {}, {}]  # by toxic + 2 * curve
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        every = list(dict.fromkeys(chain.from_iterable(held)))
        c = [np.fromiter((of.get(w, 0) for w in every), np.int64, len(every)) for of in held]
        if every:
            yield pa.record_batch([pa.array(every, pa.string()), *map(pa.array, (c[0] + c[2], c[1] + c[3], c[0], c[1]))], names=["word", *COUNTS])
        for of in held:
            of.clear()

    for batch in batches:
        for text, toxic, curve in zip(*(c for c in batch.columns), strict=True):
            of = held[toxic.as_py() + 2 * curve.as_py()]
            for w in set(WORD(text.as_py().lower())):
                n = of.get(w, 0)
                of[w] = n + 1
                size += 0 if n else len(w)
            if size > HELD_CHARS or sum(map(len, held)) > COUNTED:
                yield from flushed()
                size = 0
    yield from flushed()


def _summed_grams(words: list[str], weights: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """gram and the sums of its words' weights (a row for each of ``names``), step by step."""
    for grams in Grams.steps(words):
        _, first, back = np.unique(grams.gram, return_index=True, return_inverse=True)
        sums = [np.bincount(back, w[grams.word], len(first)) for w in weights]
        yield pa.record_batch([pa.array([grams.name(i) for i in first.tolist()], pa.string()), *map(pa.array, sums)], names=["gram", *names])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _summed_grams(batch.column(0).to_pylist(), np.stack([c.to_numpy().astype(float) for c in batch.columns[1:]]), list(COUNTS))


def _shared(grams: DataFrame) -> DataFrame:
    """x (up to ``ORDER`` characters without a word's start), p, p_trial: the shared Kneser-Ney probability of its last character after the others."""
    has = {"n": F.col("n0") + F.col("n1") > 0, "m": F.col("m0") + F.col("m1") > 0}
    full = grams.select(F.substring("gram", 2, ORDER).alias("x"), F.length("gram").alias("size"), *[c.alias(k) for k, c in has.items()])
    levels: list[DataFrame] = []
    for size in range(ORDER, 0, -1):
        # different left extensions: strings one longer, and the n-grams that begin with the word's start
        left = full.where(F.col("size") == size + 1).select("x", "n", "m")
        if levels:
            left = left.unionByName(levels[-1].select(F.substring("x", 2, ORDER).alias("x"), F.col("n") > 0, F.col("m") > 0).toDF("x", "n", "m"))
        levels.append(staged(left.groupBy("x").agg(F.count_if("n").alias("n"), F.count_if("m").alias("m")), "continuations"))
    done: list[DataFrame] = []
    for level in reversed(levels):
        w = Window.partitionBy(F.expr("left(x, length(x) - 1)"))
        columns = {}
        for n, p in (("n", "p"), ("m", "p_trial")):
            total, kinds = F.sum(n).over(w), F.count_if(F.col(n) > 0).over(w)
            rest = F.col(f"low_{p}") if done else F.lit(1.0) / F.greatest(kinds, F.lit(1))
            own = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * rest) / F.greatest(total, F.lit(1))
            columns[p] = F.when(total > 0, own).otherwise(rest)
        if done:
            below = done[-1].select(F.col("x").alias("tail"), F.col("p").alias("low_p"), F.col("p_trial").alias("low_p_trial"))
            level = level.withColumn("tail", F.substring("x", 2, ORDER)).join(below, "tail")
        done.append(staged(level.withColumns(columns).select("x", "p", "p_trial"), "shared"))
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    for level in levels:
        drop_staged(level)
    return out


def _of_history(whole: bool = True) -> WindowSpec:
    """All rows of a history, or those up to a row: one sort serves both."""
    w = Window.partitionBy("history").orderBy("gram")
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if whole else w


def _is_first() -> Column:
    return F.row_number().over(_of_history(whole=False)) == 1


def _discounted(n: str, pooled: Column) -> tuple[Column, Column]:
    """Log probability of an n-gram whose class count is ``n``, and the log of its history's share of backoff, by windows over the history."""
    w = _of_history()
    total, kept = F.sum(n).over(w), F.sum(F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))).over(w)
    share = (total - kept + STRENGTH) / (total + STRENGTH)
    return F.log(F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / (total + STRENGTH) + share * pooled), F.log(share)


def _both_classes(grams: DataFrame, shared: DataFrame) -> DataFrame:
    """gram, history, whether it is the history's first row, and for final and trial model (``_trial``) ordinary, pooled and share; null where the model hasn't seen it."""
    rows = grams.withColumns({"x": F.substring("gram", 2, ORDER), "history": F.expr("left(gram, length(gram) - 1)")}).join(shared, "x")
    w = _of_history()
    for n, p, end in (("n", "p", ""), ("m", "p_trial", "_trial")):
        both = F.col(f"{n}0") + F.col(f"{n}1")
        total, kinds = F.sum(both).over(w), F.count_if(both > 0).over(w)
        pooled = (F.greatest(both - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.greatest(F.col(p), F.lit(1e-9))) / total
        rows = rows.withColumns({f"pooled{end}": F.when(both > 0, pooled), f"total{end}": total})
    for n, end in (("n", ""), ("m", "_trial")):
        ordinary, share = _discounted(f"{n}0", F.col(f"pooled{end}"))
        rows = rows.withColumns({f"ordinary{end}": ordinary, f"share{end}": F.when(F.col(f"total{end}") > 0, share)})
    logs = {f"pooled{end}": F.log(f"pooled{end}") for end in ("", "_trial")}
    return rows.withColumns(logs).select("gram", "history", _is_first().alias("first"), "n1", *[f"{c}{end}" for end in ("", "_trial") for c in ("ordinary", "pooled", "share")])


def _write_table(rows: DataFrame, values: list[str], shares: list[str], size: int, folder: str) -> int:
    """Writes n-grams with ``values``, and histories (``rows`` where ``first``) with ``shares``, as slices of sorted keys with an index of where their leading bits begin.

    size: of n-grams and histories, at most. Returns how many slices.
    """
    columns = [*values, *shares]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nothing = pa.array(np.full(batch.num_rows, np.nan, np.float32))
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            key = pa.array(keys_of(of["gram"].to_pylist()).view(np.int64))
            yield pa.record_batch([key, *(of[c] if c in values else nothing for c in columns)], names=["key", *columns])
            past = batch.filter(of["first"])
            key = pa.array(keys_of([PAST + x for x in past["history"].to_pylist()]).view(np.int64))
            yield pa.record_batch([key, *(past[c] if c in shares else nothing[: past.num_rows] for c in columns)], names=["key", *columns])

    floats = [F.coalesce(F.col(c), F.lit(float("nan"))).cast("float").alias(c) for c in columns]
    kind = "key long, " + ", ".join(f"{c} float" for c in columns)
    entries = rows.select("gram", "history", "first", *floats).mapInArrow(keyed, kind)
    slices = 1 << (size // SLICE_ROWS).bit_length()
    bits = slices.bit_length() - 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        of = int(parts[0][0][0])
        key, *values = (np.concatenate([x[k] for x in parts]) for k in range(1, len(columns) + 2))
        key = key.view(np.uint64)
        order = np.argsort(key)
        key = key[order]
        lead_bits = max(1, len(key).bit_length())
        index = np.searchsorted(key << np.uint64(bits) >> np.uint64(64 - lead_bits), np.arange((1 << lead_bits) + 1, dtype=np.uint64))
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        for name, data in (("key", key), ("index", index.astype("<u4")), *((c, v[order].astype("<f4")) for c, v in zip(columns, values, strict=True))):
            own = f"{path}/.{of}-{TaskContext.get().taskAttemptId()}.{name}"
            with store.open_output_stream(own) as out:
                out.write(data.tobytes())
            store.move(own, f"{path}/{of}.{name}")
        yield pa.record_batch({"slice": pa.array([of], pa.int32())})

    slice_of = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = entries.select(slice_of.alias("slice"), *entries.columns).repartitionById(slices, F.col("slice"))
    dealt.mapInArrow(releasing(write), "slice int").count()
    return slices


class Table:
    """A written table, memory-mapped: values of keys, not-a-number where there is none."""

    def __init__(self, folder: str, slices: int, columns: list[str]):
        self.bits, self.width = slices.bit_length() - 1, len(columns)
        self.slices = [self._slice(folder, k, columns) for k in range(slices)]

    @staticmethod
    def _slice(folder: str, k: int, columns: list[str]):
        try:
            return open_array(folder, f"{k}.key", "<u8"), open_array(folder, f"{k}.index", "<u4"), [open_array(folder, f"{k}.{c}", "<f4") for c in columns]
        except FileNotFoundError:  # no key fell into it
            return None

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """A row for each column."""
        out = np.full((self.width, len(keys)), np.nan, np.float32)
        if not self.bits:
            self._fill(0, keys, slice(None), out)
            return out
        which = (keys >> np.uint64(64 - self.bits)).astype(np.uint16)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(self.slices) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[k] : bounds[k + 1]]
            self._fill(k, keys[at], at, out)
        return out

    def _fill(self, k: int, keys: np.ndarray, to, out: np.ndarray) -> None:
        if self.slices[k] is None:
            return
        own, index, values = self.slices[k]
        lead = (keys << np.uint64(self.bits) >> np.uint64(64 - (len(index) - 2).bit_length())).astype(np.int64)
        at, end = index[lead], index[lead + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left].astype(np.int64), end[left].astype(np.int64)
        to = np.arange(len(keys)) if isinstance(to, slice) else to
        while len(left):
            hit = own[at] == keys[left]
            for column, value in zip(out, values, strict=True):
                column[to[left[hit]]] = value[at[hit]]
            at = at + 1
            go = np.flatnonzero(~hit & (at < end))
            left, at, end = left[go], at[go], end[go]


class Trained:
    """A model's folders and numbers of slices (0: no model), and the curve's weights."""

    def __init__(self, both: tuple[str, int], toxic: tuple[str, int], weights: np.ndarray):
        self.both, self.toxic, self.weights = both, toxic, weights

    def evidence_of(self, trial: bool = False):
        """The function from words to log P(word | toxic) - log P(word | ordinary)."""
        end = "_trial" * trial
        both, toxic = Table(*self.both, [f"ordinary{end}", f"pooled{end}", f"share{end}"]), Table(*self.toxic, [f"toxic{end}", f"toxic_share{end}"])

        def of(words: list[str]) -> np.ndarray:
            out = np.zeros(len(words))
            for grams in Grams.steps(words):
                ordinary, pooled, _ = both[grams.gram]
                own = toxic[grams.gram][0]
                share = np.nan_to_num(toxic[grams.history][1])
                value = np.where(np.isnan(own), share + pooled, own) - ordinary
                unseen = np.flatnonzero(np.isnan(pooled))
                value[unseen] = share[unseen] - np.nan_to_num(both[grams.history[unseen]][2])
                low = grams.word[0]
                sums = np.bincount(grams.word - low, value)
                out[low : low + len(sums)] += sums
            return out

        return of


def _mixed(e: np.ndarray) -> np.ndarray:
    """A word's evidence where it is toxic with probability SHARE."""
    return np.log1p(SHARE * np.expm1(np.minimum(e, 50)))


class Scorer:
    """Evidence of texts: sum over words, and their number. Words seen before come from a bounded memo."""

    def __init__(self, trained: Trained, trial: bool = False):
        self.evidence_of, self.memo, self.size = trained.evidence_of(trial), {}, 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [WORD(text.lower()) for text in texts]
        every = set().union(*lists)
        new = every.difference(self.memo)
        if len(self.memo) + len(new) > MEMO or self.size > HELD_CHARS:
            self.memo.clear()
            new, self.size = every, 0
        some = list(new)
        self.size += sum(map(len, some))
        self.memo.update(zip(some, _mixed(self.evidence_of(some)).tolist(), strict=True))
        total = np.fromiter((sum(map(self.memo.__getitem__, words)) for words in lists), float, len(texts))
        return total, np.fromiter(map(len, lists), float, len(texts))


def features(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A constant, and evidence normalised by length: a word's mean, and the sum over the root of the number of words."""
    n = np.maximum(size, 1)
    return np.stack([np.ones(len(n)), np.clip(100 * total / n, -5, 20), np.clip(10 * total / np.sqrt(n), -5, 20)], axis=1)


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _curve_fold(by_fold: dict[tuple[int, int], int]) -> int | None:
    """The first fold with both kinds of labels, both of which other folds have too."""
    for fold in CURVE_FOLDS:
        others = [sum(n for (f, toxic), n in by_fold.items() if f != fold and toxic == kind) for kind in (0, 1)]
        if all(others) and all(by_fold.get((fold, kind)) for kind in (0, 1)):
            return fold
    return None


def _toxic_words(trained: Trained | None):
    """Words with n1, m1 to their n-grams' summed weights: the counts, times the probability that the word is toxic under a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [trained.evidence_of(trial) for trial in (False, True)] if trained else []
        for batch in batches:
            words = batch.column(0).to_pylist()
            weights = np.stack([batch.column(k).to_numpy().astype(float) for k in (1, 2)])
            for weight, model in zip(weights, models, strict=False):
                odds = SHARE / (1 - SHARE) * np.exp(np.clip(model(words), -50, 50))
                weight *= odds / (1 + odds)
            yield from _summed_grams(words, weights, ["w", "w_trial"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Trained:
    """Learns from the labelled rows outside the held-out part."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", (F.crc32(F.col("id").cast("string")) % 4).cast("int")).where(F.col("fold") != HELD_OUT)
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).join(known, "id")
    by_fold = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    if {toxic for _, toxic in by_fold} != {0, 1}:
        return Trained(("", 0), ("", 0), np.array([-1e9, 0, 0]))
    fold = _curve_fold(by_fold)
    in_curve = F.lit(0) if fold is None else (F.col("fold") == fold).cast("int")
    longs = ", ".join(f"{c} long" for c in COUNTS)
    counted = rows.select("text", "toxic", in_curve.alias("curve")).mapInArrow(releasing(_count_words), f"word string, {longs}")
    words = staged(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]), "words")
    grams = words.mapInArrow(releasing(_grams), "gram string, " + ", ".join(f"{c} double" for c in COUNTS)).groupBy("gram")
    grams = staged(grams.agg(*[F.sum(c).alias(c) for c in COUNTS]), "ngrams")
    static = staged(_both_classes(grams, _shared(grams)), "both_classes")
    ends = ("", "_trial")
    folder = shared_dir(spark, "toxicity_model")
    values, shares = [f"{c}{end}" for end in ends for c in ("ordinary", "pooled")], [f"share{end}" for end in ends]
    both = f"{folder}/both", _write_table(static, values, shares, 2 * static.count(), f"{folder}/both")
    pooled = staged(static.where("n1 > 0").select("gram", "history", *[F.exp(f"pooled{end}").alias(f"pooled{end}") for end in ends]), "pooled")
    size = 2 * pooled.count()
    trained = None
    for k in range(ROUNDS + 1):
        weighted = words.where("n1 > 0").select("word", "n1", "m1").mapInArrow(releasing(_toxic_words(trained)), "gram string, w double, w_trial double")
        toxic = weighted.groupBy("gram").agg(*[F.sum(f"w{end}").alias(f"w{end}") for end in ends]).join(pooled, "gram")
        columns = {"first": _is_first()}
        for end in ends:
            columns[f"toxic{end}"], columns[f"toxic_share{end}"] = _discounted(f"w{end}", F.col(f"pooled{end}"))
        slices = _write_table(toxic.withColumns(columns), [f"toxic{end}" for end in ends], [f"toxic_share{end}" for end in ends], size, f"{folder}/toxic-{k}")
        trained = Trained(both, (f"{folder}/toxic-{k}", slices), np.array(FIXED_CURVE))
    for frame in (words, grams, static, pooled):
        drop_staged(frame)
    if fold is not None:
        of_fold = rows.where(F.col("fold") == fold)
        picked = of_fold.select("id").distinct().orderBy(F.xxhash64("id")).limit(CURVE_ROWS)
        sample = of_fold.join(F.broadcast(picked), "id").select("id", "toxic", "text")
        schema = sample.select("id", "toxic").schema.add("total", "double").add("size", "double")
        sample = sample.mapInArrow(releasing(_evidence(trained)), schema).groupBy("id").agg(*[F.avg(c).alias(c) for c in ("toxic", "total", "size")]).orderBy("id").toArrow()
        trained.weights = curve(features(sample["total"].to_numpy(), sample["size"].to_numpy()), sample["toxic"].to_numpy())
    return trained


def _evidence(trained: Trained):
    """(id, toxic, text) to id, toxic, evidence of the trial model, and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(trained, trial=True)
        for batch in (some for b in batches for some in slices(b, 2, TEXTS, TEXT_BYTES)):
            total, size = scorer(batch.column(2).to_pylist())
            yield pa.record_batch([*batch.columns[:2], pa.array(total), pa.array(size)], names=["id", "toxic", "total", "size"])

    return run


def score(docs: DataFrame, trained: Trained, keep: list[str], text_column: str = "text", score_column: str = "score") -> DataFrame:
    """The columns in ``keep`` and the score of every row."""
    if not trained.both[1]:
        return docs.select(*keep).withColumn(score_column, F.lit(0.0))
    kept = docs.select(*keep, text_or_empty(text_column).alias(unused(docs, "scored_text")))
    schema = docs.select(*keep).schema.add(score_column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(trained)
        for batch in (some for b in batches for some in slices(b, b.num_columns - 1, TEXTS, TEXT_BYTES)):
            x = features(*scorer(batch.column(batch.num_columns - 1).to_pylist())) @ trained.weights
            value = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
            yield pa.record_batch([*batch.columns[:-1], pa.array(value)], names=[*batch.schema.names[:-1], score_column])

    return kept.mapInArrow(releasing(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    name = unused(docs, "score")
    return score(docs, train(docs, labels), docs.columns, score_column=name).where(F.col(name) < threshold).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

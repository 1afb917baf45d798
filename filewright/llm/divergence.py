"""Source divergence audit: how far each source's use of words is from the other sources of its language, and by which terms.

Sort-based streaming. Each task sorts its documents' terms by (lang, source, term, document) some millions at a time, and a run-length scan
gives, for each (lang, source, term), the number of documents and of occurrences; documents are summed out here, so that a word which
a third of all documents hold leaves a task as one row a source. These partial runs are hashed by (lang, term), sorted by (lang, term, source) and
scanned again: a run that crosses Arrow batches is carried on in summed form. A term that ``least`` documents of its language hold is kept,
with its count in each source, in a written table. A last scan over it works out all shares and emits, for each task, partial sums for
pairs of sources and the terms that may be among the ``top`` ones.

All arithmetic is exact: shares are integers of ``UNIT`` parts, p = 1 + floor(UNIT * (count + 1) / (N + V)), worked out in steps that stay within 64 bits for N + V below
9e15, and a divergence is floor((p - q) * (p - q) / q). A pair's terms that neither source has share one value, so a
term costs its own sources times all sources of the language.

What a task holds: ``BUFFER`` terms; the sources of one language (``GROUPS`` pairs of language and source at a time go to the tasks, more are worked off one
after the other); sums for ``CELLS`` pairs at a time, more sources are worked off in stripes.

Defined results: null text, lang and source are ''; a row is a document, so repeated rows and ids count each; a group whose texts have no term is there with
count 0; a language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.llm.common import partitions, releasing, staged, table
from filewright.llm.terms import Numbers, Terms, run_starts

UNIT = 1_000_000_000
LETTERS = Terms(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Occurrences that a task sorts at a time; terms and documents (and 16 times the groups) that it numbers at a time.
BUFFER, NUMBERED = 1 << 22, 1 << 20
#: Occurrences from which a text is summed by itself.
LONG = 1 << 18
GROUPS, CELLS = 100_000, 1 << 22
RUN = "lang string, source string, term string, docs long, n long"
KEPT = "lang string, term string, sources array<string>, counts array<long>"
PARTIAL = "part string, lang string, source string, item string, value long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to partial runs."""
    terms, groups, held, summed, size = Numbers(), Numbers(), [], [], 0

    def flush() -> pa.RecordBatch:
        group, term = (np.repeat([h[k] for h in held], [len(h[1]) for h in held]) if k == 0 else np.concatenate([h[k] for h in held]) for k in (0, 1)) if held else (np.zeros(0, np.int64),) * 2
        doc = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        key = np.sort((group * len(terms) + term) * max(1, len(held)) + doc)
        at = run_starts(key)  # a row for each document of a term
        key, n = key[at] // max(1, len(held)), np.diff(np.append(at, len(key)))
        key = np.concatenate([key, *(g * len(terms) + t for g, t, _ in summed)])
        n = np.concatenate([n, *(c for _, _, c in summed)])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        at = run_starts(key)
        docs, n = np.diff(np.append(at, len(key))), np.add.reduceat(n, at)
        group, term = np.divmod(key[at], len(terms))
        langs, sources = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(group)) for k in (0, 1))
        words = pa.array(list(terms), pa.binary()).cast(pa.string()).take(pa.array(term))
        return pa.record_batch([langs, sources, words, pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=["lang", "source", "term", "docs", "n"])

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                parts = []
                for found in LETTERS(text):
                    x = np.fromiter(map(terms.__getitem__, found), np.int64, len(found))
                    if parts or len(found) > LONG:  # a long text is summed slice by slice
                        x = np.unique(x, return_counts=True)
                    parts.append(x)
                if len(parts) == 1 and not isinstance(parts[0], tuple):
                    held.append((groups[lang, source], parts[0]))
                    size += len(parts[0])
                elif parts:
                    parts = [x if isinstance(x, tuple) else np.unique(x, return_counts=True) for x in parts]
                    x, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                    n = np.zeros(len(x), np.int64)
                    np.add.at(n, back, np.concatenate([n for _, n in parts]))
                    summed.append((groups[lang, source], x, n))
                    size += len(x)
                if size > BUFFER or len(terms) > NUMBERED or len(held) > NUMBERED or len(groups) > NUMBERED >> 4:
                    yield flush()
                    terms, groups, held, summed, size = Numbers(), Numbers(), [], [], 0
    if held or summed:
        yield flush()


def _kept(least: int):
    """Sorted partial runs to the kept terms, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def scan(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            """The rows' whole runs, and the last run summed, as more of it may come."""
            lang, source, term = (rows.column(k).combine_chunks() for k in ("lang", "source", "term"))
            differ = lambda c: np.concatenate([[True], pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)])
            new_term = differ(lang) | differ(term)
            at = np.flatnonzero(new_term | differ(source))
            docs, n = (np.add.reduceat(rows.column(k).to_numpy(), at) for k in ("docs", "n"))
            firsts = np.flatnonzero(new_term[at])
            end = len(at) if last else int(firsts[-1])
            rest = None if last else pa.table({"lang": lang.take(pa.array(at[end:])), "source": source.take(pa.array(at[end:])), "term": term.take(pa.array(at[end:])), "docs": docs[end:], "n": n[end:]})
            firsts = firsts[firsts < end]
            if not len(firsts):
                return None, rest
            enough = np.add.reduceat(docs[:end], firsts) >= least
            sizes = np.diff(np.append(firsts, end))
            own = np.repeat(enough, sizes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[enough])]), pa.int32())
            at = at[:end]
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (source.take(pa.array(at[own])), pa.array(n[:end][own], pa.int64()))]
            places = pa.array(at[firsts[enough]])
            return pa.record_batch([lang.take(places), term.take(places), *lists], names=["lang", "term", "sources", "counts"]), rest

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                out, held = scan(rows if held is None else pa.concat_tables([held, rows]), False)
                if out is not None and out.num_rows:
                    yield out
        if held is not None:
            out, _ = scan(held, True)
            if out is not None and out.num_rows:
                yield out

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + 1) / total), exactly, by long division to the base 1,000."""
    x = counts + 1
    out, rest = np.divmod(x, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Language:
    """One language's sources, and what a task has gathered of it for a stripe of them."""

    def __init__(self, name: str, sources: list[str], totals: list[int], terms: int, stripe: tuple[int, int], top: int):
        self.name, self.sources, self.numbers, self.top = name, sources, {s: i for i, s in enumerate(sources)}, top
        self.totals, self.all = np.array(totals, np.int64) + terms, sum(totals) + terms
        self.begin, self.end = stripe[0], min(stripe[1], len(sources))
        self.none = shares(np.zeros(len(sources), np.int64), self.totals)
        self.sums = np.zeros((self.end - self.begin, len(sources)), np.int64)
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def add(self, terms: list[bytes], sizes: np.ndarray, sources: list[str], counts: np.ndarray) -> None:
        s = len(self.sources)
        matrix = np.zeros((len(terms), s), np.int64)
        matrix[np.repeat(np.arange(len(terms)), sizes), [self.numbers[x] for x in sources]] = counts
        p, there = shares(matrix, self.totals), matrix > 0
        q = shares(matrix.sum(axis=1), np.int64(self.all))
        stripe = slice(self.begin, self.end)
        for k in range(s):
            own = np.flatnonzero(there[:, k])
            if not len(own):
                continue
            if self.begin <= k < self.end:  # where source k has the term, against all sources
                self.sums[k - self.begin] += (divergences(p[own, k][:, None], p[own]) - divergences(self.none[k], self.none)).sum(axis=0)
                self._best(k, terms, own[p[own, k] > q[own]], p[:, k], q)
            # and the sources that don't have it, against source k
            lack = divergences(self.none[stripe][None, :], p[own, k][:, None]) - divergences(self.none[stripe], self.none[k])
            self.sums[:, k] += np.where(there[own, stripe], 0, lack).sum(axis=0)

    def _best(self, k: int, terms: list[bytes], rows: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        best = self.best.setdefault(k, [])
        best += [(-v, terms[i]) for i, v in zip(rows.tolist(), divergences(p[rows], q[rows]).tolist(), strict=True)]
        if len(best) > 4 * self.top:
            best.sort()
            del best[self.top :]

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = pa.array(self.sources, pa.string())
        for k in range(self.begin, self.end):
            n = len(self.sources)
            own = sorted(self.best.get(k, []))[: self.top]
            value = np.concatenate([self.sums[k - self.begin], np.array([-v for v, _ in own], np.int64)])
            item = pa.concat_arrays([names, pa.array([t.decode() for _, t in own], pa.string())])
            parts = pa.array(["pair"] * n + ["term"] * len(own), pa.string())
            yield pa.record_batch([parts, pa.array([self.name] * len(value), pa.string()), pa.array([self.sources[k]] * len(value), pa.string()), item, pa.array(value)], names=["part", "lang", "source", "item", "value"])


def _partial(languages: dict[str, tuple], stripe: tuple[int, int], top: int):
    """Kept terms to partial sums of pairs and candidates of terms, for the languages given and sources of a stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        for batch in batches:
            lang = batch.column(0).to_pylist()
            at = 0
            while at < len(lang):
                if lang[at] not in languages:
                    at += 1
                    continue
                if now is None or now.name != lang[at]:
                    if now is not None:
                        yield from now.rows()
                    now = _Language(lang[at], *languages[lang[at]], stripe, top)
                end, most = at, at + max(1, (1 << 18) // len(now.sources))
                while end < min(len(lang), most) and lang[end] == now.name:
                    end += 1
                some = batch.slice(at, end - at)
                lists = some.column(2)
                terms = some.column(1).cast(pa.binary()).to_pylist()
                now.add(terms, pc.list_value_length(lists).to_numpy(), lists.flatten().to_pylist(), some.column(3).flatten().to_numpy())
                at = end
        if now is not None:
            yield from now.rows()

    return run


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, sources, counts of the terms that ``least`` documents of the language hold; a lang's terms come together in a partition."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = rows.mapInArrow(releasing(_runs), RUN).repartition(partitions(spark), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return runs.mapInArrow(releasing(_kept(least)), KEPT)


def _language_batches(groups: DataFrame) -> Iterator[dict[str, tuple]]:
    """Languages with their sources, totals and numbers of terms, ``GROUPS`` sources at a time (or one language)."""
    batch, size = {}, 0
    for lang, sources in groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total", "terms")))).orderBy("lang").toLocalIterator():
        if batch and size + len(sources) > GROUPS:
            yield batch
            batch, size = {}, 0
        batch[lang] = [s.source for s in sources], [s.total for s in sources], sources[0].terms
        size += len(sources)
    if batch:
        yield batch


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank for every (lang, source) of ``docs``."""
    kept = staged(kept_terms(docs, least), "kept_terms")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = F.lit(0).cast("long")
    groups = staged(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")), "divergence_groups")
    found = None
    for languages in _language_batches(groups):
        widest = max(len(v[0]) for v in languages.values())
        stripe = max(1, CELLS // widest)
        of = kept if found is None and len(languages) == groups.select("lang").distinct().count() else kept.where(F.col("lang").isin(list(languages)))
        for begin in range(0, widest, stripe):
            rows = of.mapInArrow(releasing(_partial(languages, (begin, begin + stripe), top)), PARTIAL)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    found = staged(found, "partial_divergence")
    none = F.expr(f"1 + {UNIT} div (total + terms)")
    own = groups.where("terms > 0").select("lang", "source", none.alias("p"))
    sums = found.where("part = 'pair' and source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a pair's value for a term that neither has; with the terms' number it is the pair's sum but for what the tasks found
    base = own.join(groups.where("terms > 0").select("lang", F.col("source").alias("item"), none.alias("q"), "terms"), "lang").where("source <> item")
    pairs = base.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.coalesce("value", zero) + F.col("terms") * F.expr("(p - q) * (p - q) div q")).alias("value"))
    empty = groups.where("terms = 0")
    pairs = pairs.unionByName(empty.select("lang", "source").join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", zero))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value", ranked.alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + ({UNIT}::HUGEINT * (c.n + 1)) // (t.total + s.v) AS p FROM counts c JOIN totals t USING (lang, source) JOIN sizes s USING (lang)),
q AS (SELECT k.lang, k.term, 1 + ({UNIT}::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q FROM kept k JOIN sizes s USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200"""

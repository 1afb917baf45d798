import random
import re
from collections import Counter, defaultdict

import pytest
from data import COLUMNS, awkward, frame

from filewright.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, top=200):
    """docs: (text, lang, source)."""
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        holders[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + (10**9 * (c[t] + 1)) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        for s in sources:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted(((-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(terms[:top], 1)}
    return out


def rows(df):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéñßZ" for b in "xyzß日"]
    docs = [(" ".join(rng.choices(words[: rng.choice((10, 45))], k=rng.randrange(0, 60))), rng.choice(("en", "fr", None)), rng.choice(("s1", "s2", "s3", "é", None))) for _ in range(120)]
    return docs + [(None, "en", "s1"), ("", "xx", "only"), ("one two", "zz", "a"), ("", "zz", "b"), ("Don't STOP-it 12x", "en", "s1"), ("x " * 5000, "fr", "s2")]


def table(spark, docs):
    return spark.createDataFrame([(i, text, lang, source, 0, 7, None, 0.5, "x") for i, (text, lang, source) in enumerate(docs)], COLUMNS)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    assert rows(D.divergence(table(spark, docs))) == brute(docs)


def test_bounds_change_nothing(spark, monkeypatch):
    """Small buffers, long texts summed apart, languages one after the other, stripes of sources and few best terms."""
    docs = corpus(5)
    expected = brute(docs, top=4)
    for name, value in (("BUFFER", 50), ("LONG", 20), ("GROUPS", 1), ("CELLS", 7)):
        monkeypatch.setattr(D, name, value)
    assert rows(D.divergence(table(spark, docs), top=4)) == expected


def test_a_run_over_many_batches(spark):
    """A run is carried over Arrow batches in summed form."""
    docs = corpus(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(D.divergence(table(spark, docs).repartition(12))) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_and_empty(spark):
    assert rows(D.divergence(frame(spark, awkward()))) == brute([(t, "en", "s") for _, t in awkward()])
    assert D.divergence(frame(spark, [])).collect() == []


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10**15)
        n = rng.randrange(0, total)
        assert D.shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total

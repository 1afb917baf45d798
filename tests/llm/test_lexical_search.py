import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from data import awkward, frame

from filewright.llm import lexical_search as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    own = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for i, c, n in own:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def questions(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id string, score int")


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "A1b2"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((5, 63))]) for _ in range(rng.randrange(n)))
    docs = [(i, text(40)) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (None, docs[3][1]), (7, docs[3][1]), (-4, docs[3][1])]  # ties over more than the top
    items = [(i, text(12)) for i in range(20)] + [(30, docs[3][1]), (31, None), (32, ""), (33, "nowhere at all"), (30, docs[3][1]), (34, "w1 w1 w1 W2,w2;w3")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    got = S.search(frame(spark, docs).repartition(3), questions(spark, [(i, t, "x", 1) for i, t in items]))
    assert found(got) == brute(docs, items)


def test_bounds_change_nothing(spark, monkeypatch):
    """Ranges of few documents and leaves, and items in blocks of few terms."""
    docs, items = corpus(7)
    for name, value in (("RANGE", 9), ("LEAF", 2), ("FAN", 2), ("VOCABULARY", 15)):
        monkeypatch.setattr(S, name, value)
    assert found(S.search(frame(spark, docs), questions(spark, [(i, t, "x", 1) for i, t in items]), top=4)) == brute(docs, items, 4)


def test_awkward_and_empty(spark):
    items = [(1, "w1x w2x"), (2, "日本 12"), (3, "a"), (None, "ab")]
    ask = questions(spark, [(i, t, "x", 1) for i, t in items])
    assert found(S.search(frame(spark, awkward()), ask)) == brute(awkward(), items)
    assert S.search(frame(spark, []), ask).collect() == [] and S.search(frame(spark, awkward()), ask.limit(0)).collect() == []
    assert S.search(frame(spark, [(1, None), (2, "")]), ask).collect() == []


def test_branch_and_bound_opens_few_leaves_and_all_equal_ones():
    n = 4096
    terms = np.concatenate([np.arange(3)] * n)
    tfs = np.ones(3 * n, np.int64)
    tfs[3 * 1000] = tfs[3 * 3000] = 50
    trees = S.RangeTrees(list(range(n)), np.full(n, 20), np.arange(n + 1) * 3, terms, tfs, n, 20 * n)
    best = []
    assert trees.search(np.arange(3), np.array([5, 3, 1]), best, 2) == 2 and sorted(-x[2] for x in best) == [1000, 3000]
    best = []
    assert trees.search(np.arange(3), np.array([5, 3, 1]), best, 3) == n // S.LEAF  # the third place is a tie of all others
    assert sorted(-x[2] for x in best) == [0, 1000, 3000]


def test_norms_beyond_64_bits():
    n = np.array([10**7, 3])
    assert S.norms(n, 10**11, 10**13).tolist() == [25 + 75 * 10**7 * 10**11 // 10**13, 25 + 75 * 3 * 10**11 // 10**13]

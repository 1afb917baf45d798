import random

import numpy as np
import pytest
from data import awkward, frame, words

from filewright.llm import common
from filewright.llm import near_dedup as D


def shingles(text, idf):
    owner, shingle, weight = D.elements([text], idf)
    return dict(zip(shingle.tolist(), weight.tolist(), strict=True))


def similarity(a, b):
    keys = set(a) | set(b)
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 0.0


def family(rng, n, size, edits):
    base = words(rng, size, 10_000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_elements():
    idf = np.zeros(D.DF_CELLS)
    got = shingles("A b c, d E f! a B c d e f", idf)
    assert sorted(got.values()) == [1.0] * 4 + [2.0] * 2  # a b c d e and b c d e f twice
    assert len(shingles("one two", idf)) == 1 and not shingles("", idf) and not shingles("?!", idf)
    a, b = shingles("x y z " * 30, idf), shingles("x y z " * 15, idf)
    assert abs(similarity(a, b) - D.weighted_jaccard(*((np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in (a, b)))) < 1e-12


def test_samples_agree_as_often_as_texts_are_similar():
    rng, idf = random.Random(4), np.zeros(D.DF_CELLS)
    agree, expected = [], []
    for _ in range(150):
        a, b = family(rng, 2, 120, 1)
        keys, sketches = D.band_keys(*D.elements([a, b], idf), 2)
        s = similarity(shingles(a, idf), shingles(b, idf))
        agree.append((keys[0] == keys[1]).mean())
        expected.append(s**D.ROWS)
        assert abs((sketches[0] == sketches[1]).mean() - s) < 0.35
    assert abs(np.mean(agree) - np.mean(expected)) < 0.03


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    line = words(rng, 14)
    texts = [t for size in (40, 80, 200) for _ in range(4) for t in family(rng, 5, size, 1)]
    texts += family(rng, 60, 150, 2) + [line + " " + words(rng, 12, 10_000) for _ in range(80)] + [texts[0]] * 40
    docs = list(enumerate(texts)) + [(i + 5000 if i is not None else None, t) for i, t in awkward()]
    rng.shuffle(docs)
    df = frame(spark, docs)
    rows = D.near_classes(df).collect()
    assert len(rows) == len(docs)
    idf = np.asarray(D.open_array(D.inverse_frequencies(df), "idf", "<f4"))
    distinct = sorted({t or "" for _, t in docs})
    sets = [shingles(t, idf) for t in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in range(i):
            if len(distinct[i]) < 50_000 and len(distinct[j]) < 50_000 and similarity(sets[i], sets[j]) >= D.SIMILARITY:
                root[find(i)] = find(j)
    order = {r.row: r for r in rows}
    text_of = dict(zip(sorted(order), (t or "" for _, t in docs), strict=True))
    pairs = {(find(distinct.index(text_of[r.row])), r.class_row) for r in rows}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("outside", [D.OUTSIDE, 4])
def test_large_groups_lose_no_link(spark, monkeypatch, outside):
    """Edits of one text, each near to it and far from one another, among texts that share a passage; in blocks, and divided by further bands."""
    labels, own = [], D.staged
    monkeypatch.setattr(D, "staged", lambda df, label: (labels.append(label), own(df, label))[1])
    monkeypatch.setattr(D, "OUTSIDE", outside)
    monkeypatch.setattr(D, "SMALL", min(D.SMALL, outside))
    rng = random.Random(21)
    base = words(rng, 112, 10_000).split()
    variants = [" ".join(base)]
    for _ in range(220):
        w = list(base)
        for at in rng.sample(range(5, 106, 5), 2):
            w[at] = f"e{rng.randrange(10**6)}"
        variants.append(" ".join(w))
    passage = words(rng, 90, 10_000)
    texts = variants + [passage + " " + words(rng, 20, 10_000) for _ in range(120)]
    rng.shuffle(texts)
    df = frame(spark, list(enumerate(texts)))
    idf = np.asarray(D.open_array(D.inverse_frequencies(df), "idf", "<f4"))
    sets = [shingles(t, idf) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= D.SIMILARITY:
                root[find(i)] = find(j)
    got = {r.doc_id: r.class_row for r in D.near_classes(df).collect()}
    assert ("parts" in labels) == (outside == 4)
    pairs = {(find(i), got[i]) for i in range(len(texts))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_divided_groups_keep_links_of_one_band(spark, monkeypatch):
    """Pairs at 0.8 of several weights that share no band but the group's, among texts that share a passage; once as a group of all unlike texts and once beside a main class."""
    monkeypatch.setattr(D, "OUTSIDE", 4)
    monkeypatch.setattr(D, "SMALL", 4)
    rng = random.Random(8)
    passage = words(rng, 60, 10_000)
    texts, pairs = [passage + " " + words(rng, 30 + i, 10_000) for i in range(60)], set()
    for i in range(40):
        text = passage + " " + words(rng, 25 + i, 10_000)
        pairs.add((len(texts), len(texts) + 1))
        texts += [text, text + " " + words(rng, 1 + i % 12, 10_000)]
    texts += [passage + " x y"] + [passage + f" x y z{i}" for i in range(30)]
    df = frame(spark, list(enumerate(texts)))
    idf = D.inverse_frequencies(df)
    weights = np.asarray(D.open_array(idf, "idf", "<f4"))
    sets = [shingles(t, weights) for t in texts]
    expected = {(i, j) for j in range(len(texts)) for i in range(j) if similarity(sets[i], sets[j]) >= D.SIMILARITY}
    assert len(expected & pairs) > 30
    owner, shingle, weight = D.elements(texts, weights)
    _, sketches = D.band_keys(owner, shingle, weight, len(texts))
    signed = [(i, [99] + [i * 100 + k for k in range(1, D.BANDS)], sketches[i].tobytes(), float(sum(sets[i].values()))) for i in range(len(texts))]
    signed = common.staged(spark.createDataFrame(signed, "row long, bands array<long>, sketch binary, whole double"), "signed")
    rows = df.selectExpr("doc_id as row", "text")
    root = {r.node: r.root for r in D.linked_classes(signed, rows, idf).collect()}
    own = list(range(len(texts)))
    for i, j in sorted(expected) * 3:
        least = min(own[i], own[j])
        own = [least if x in (own[i], own[j]) else x for x in own]
    assert [root.get(i, i) for i in range(len(texts))] == own


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(60)] + [(7, 3), (3, 7)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == r for n, r in root.items())


def test_keeps_one_row_and_all_columns(spark):
    df = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, ""), (4, "h i j k l m")])
    kept = D.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert D.near_dedup(frame(spark, [])).count() == 0

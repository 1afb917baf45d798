import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from data import awkward, frame

from filewright.llm import toxicity as T
from filewright.llm.common import shared_dir

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=6):
    """Ordinary words for all, and for the toxic a few of a family of words that share a beginning."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["an", "er", "the", "on", "ti", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        w = [rng.choice(plain) for _ in range(rng.randint(15, 120))]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = "vexgru" + rng.choice(["m", "an", "er", "on", "p"]) + rng.choice(["a", "is", "o", "et"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return texts, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == T.HELD_OUT


def test_held_out_accuracy(spark):
    texts, labels = corpus(900)
    df = frame(spark, texts + [(i + 10_000 if i is not None else None, t) for i, t in awkward()])
    folder = T.train(df, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.s for r in T.score(df, folder, ["doc_id"], score_column="s").collect() if r.doc_id is not None and r.doc_id < 10_000}
    toxic = dict((i, t) for i, _, t in labels)
    out = [(got[i], toxic[i]) for i in got if held(i)]
    found = [s >= T.THRESHOLD for s, t in out if t]
    false = [s >= T.THRESHOLD for s, t in out if not t]
    assert len(found) > 15 and np.mean(found) > 0.9 and np.mean(false) < 0.05
    assert all(0 <= s <= 1 for s in got.values())
    kept = T.without_toxic(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and kept.count() < df.count()


def test_held_out_labels_change_nothing(spark):
    texts, labels = corpus(200)
    df = frame(spark, texts)
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    scores = [sorted((r.doc_id, r.s) for r in T.score(df, T.train(df, spark.createDataFrame(x, LABELS)), ["doc_id"], score_column="s").collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, None, None), (None, 1, 1)]])
def test_without_both_kinds_of_labels(spark, labels):
    df = frame(spark, awkward())
    folder = T.train(df, spark.createDataFrame(labels, LABELS))
    assert {round(r.s, 9) for r in T.score(df, folder, ["doc_id"], score_column="s").collect()} == {0.0}
    assert T.without_toxic(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


@pytest.mark.parametrize("empty", [(3,), (0, 1), (1, 3)])
def test_folds_without_labels(spark, empty):
    """A fold without labels, or labels in one fold only, doesn't make every document toxic."""
    texts, labels = corpus(400)
    toxic = {i for i, _, t in labels if t}
    labels = [x for x in labels if fold(x[0]) not in empty]
    df = frame(spark, texts)
    got = {r.doc_id: r.s for r in T.score(df, T.train(df, spark.createDataFrame(labels, LABELS)), ["doc_id"], score_column="s").collect()}
    found = [got[i] >= T.THRESHOLD for i in toxic]
    false = [s >= T.THRESHOLD for i, s in got.items() if i not in toxic]
    assert np.mean(false) < 0.05 and np.mean(found) > 0.5


def plain_model(docs):
    """Evidence of words, from (words, toxic) by Kneser-Ney in plain Python."""
    counts = [Counter(w for words, toxic in docs if toxic == k for w in set(words)) for k in (0, 1)]
    pad = lambda w: "\x02" + w + "\x03"
    grams_of = lambda w: [pad(w)[max(0, k - T.ORDER) : k + 1] for k in range(1, len(w) + 2)]
    n = [Counter() for _ in (0, 1)]
    for k in (0, 1):
        for w, c in counts[k].items():
            for g in grams_of(w):
                n[k][g] += c
    grams = set(n[0]) | set(n[1])
    lefts = {m: Counter() for m in range(1, T.ORDER + 1)}
    strings = {m: {pad(w)[i : i + m] for c in counts for w in c for i in range(1, len(w) + 3 - m)} for m in range(1, T.ORDER + 1)}
    for g in grams:
        if len(g) == T.ORDER + 1 or g[0] == "\x02":
            lefts[len(g) - 1][g[1:]] += 1
    for m in range(2, T.ORDER + 1):
        for x in strings[m]:
            lefts[m - 1][x[1:]] += 1

    def shared(x):
        if not x:
            return 1 / len(lefts[1])
        of = {y: c for y, c in lefts[len(x)].items() if y[:-1] == x[:-1]}
        return (max(lefts[len(x)][x] - T.DISCOUNT, 0) + T.DISCOUNT * len(of) * shared(x[1:])) / sum(of.values())

    following = {}
    for g in grams:
        following.setdefault(g[:-1], set()).add(g)

    def pooled(g):
        of = following[g[:-1]]
        return (n[0][g] + n[1][g] - T.DISCOUNT + T.DISCOUNT * len(of) * shared(g[1:])) / sum(n[0][x] + n[1][x] for x in of)

    base = {g: pooled(g) for g in grams}

    def share(c, h):
        total = sum(c[g] for g in following.get(h, ()))
        return (sum(min(c[g], T.DISCOUNT) for g in following.get(h, ())) + T.STRENGTH) / (total + T.STRENGTH), total

    def chance(c, g):
        s, total = share(c, g[:-1])
        return (max(c[g] - T.DISCOUNT, 0) / (total + T.STRENGTH) + s * base[g]) if g in grams else s

    def evidence(w, toxic):
        return sum(math.log(chance(toxic, g) / chance(n[0], g)) for g in grams_of(w))

    toxic = n[1]
    for _ in range(T.ROUNDS):
        new = Counter()
        for w, c in counts[1].items():
            odds = T.SHARE / (1 - T.SHARE) * math.exp(evidence(w, toxic))
            for g in grams_of(w):
                new[g] += c * odds / (1 + odds)
        toxic = new
    return lambda w: evidence(w, toxic)


def test_evidence_equals_plain_kneser_ney(spark):
    texts, labels = corpus(120)
    toxic = {i: t for i, _, t in labels}
    trained = T.train(frame(spark, texts), spark.createDataFrame(labels, LABELS))
    expected = plain_model([(T.WORD(t), toxic[i]) for i, t in texts if not held(i)])
    words = [*T.WORD(texts[0][1])[:10], "vexgruma", "vexgru", "vex", "quite", "unseen", "a"]
    assert np.allclose(trained.evidence_of()(words), [expected(w) for w in words], atol=1e-3)


def test_repetition_counts_and_length_does_not(spark):
    texts, labels = corpus(300)
    more = [(1001, "vexgruma " + texts[0][1]), (1002, "vexgruma " * 30 + texts[0][1]), (1003, texts[1][1]), (1004, " ".join([texts[1][1]] * 4))]
    trained = T.train(frame(spark, texts), spark.createDataFrame(labels, LABELS))
    total, size = T.Scorer(trained)([t for _, t in more])
    assert total[1] - total[0] > 20 * (total[0] - T.Scorer(trained)([texts[0][1]])[0][0]) and np.isclose(total[3] / size[3], total[2] / size[2])
    assert T.features(np.zeros(3), np.array([0.0, 5.0, 5000.0])).std(axis=0).max() == 0


def test_tables_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE_ROWS", 40)
    names = sorted({f"n{i % 97}{i}" for i in range(500)})
    folder = shared_dir(spark, "test")
    rows = spark.createDataFrame([(x, x[:-1], x.endswith("0"), float(i), -float(i)) for i, x in enumerate(names)], "gram string, history string, first boolean, v double, s double")
    slices = T._write_table(rows, ["v"], ["s"], 2 * len(names), folder)
    table = T.Table(folder, slices, ["v", "s"])
    got = table[T.keys_of([*names, "missing"])]
    assert slices > 8 and got[0, :-1].tolist() == list(map(float, range(len(names)))) and np.isnan(got[0, -1]) and np.isnan(got[1]).all()
    past = [(x, i) for i, x in enumerate(names) if x.endswith("0")]
    assert table[T.keys_of([T.PAST + x[:-1] for x, _ in past])][1].tolist() == [-float(i) for _, i in past]


def test_query_columns(spark, sf_dir):
    rows = T.op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_words_of_any_length_are_taken_in_pieces(monkeypatch):
    """Pieces give the n-grams of whole words, with bounded memory."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé日") for _ in range(n)) for n in (0, 1, 5, 30, 98, 99, 250, 3, 1000, 97, 2)]

    def grams():
        steps = list(T.Grams.steps(words))
        return len(steps), [(int(w), int(g), int(h), s.name(i)) for s in steps for i, (w, g, h) in enumerate(zip(s.word, s.gram, s.history, strict=True))]

    n, whole = grams()
    assert n == 1 and len(whole) == sum(len(w) + 1 for w in words)
    for w, gram, history, name in whole[::7]:
        assert T.keys_of([name, T.PAST + name[:-1]]).tolist() == [gram, history] and name in T.START + words[w] + T.END
    monkeypatch.setattr(T, "CHARS", 100)
    n, pieces = grams()
    assert n > 15 and pieces == whole
    monkeypatch.setattr(T, "CHARS", 1 << 18)
    tracemalloc.start()
    for _ in T.Grams.steps(["ab" * 5_000_000]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6

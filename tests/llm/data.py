"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, h long, score double, digest string"


def rows(texts):
    """Rows of (doc_id, text) with the documents' other columns and some whose names operators might use."""
    return [(i, t, "en", "s", len(t) if t is not None else None, 7, None, 0.5, "x") for i, t in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), COLUMNS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def awkward(seed=1):
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(6)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(10, None), (11, ""), (None, base[0]), (None, None), (12, base[1]), (12, base[1]), (12, base[2].upper()), (13, "a"), (13, "b")]
    texts += [(14, words(rng, 40_000, 5000)), (15, "ab " * 400), (16, "é" * 150 + base[3]), (17, base[4] + " " + base[5]), (18, "Ünï 日本 \x1c 12²3 ½"), (-5, base[5])]
    return texts

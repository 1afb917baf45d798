import hashlib
import random

import numpy as np
import pytest
from data import awkward, frame

from filewright.llm import repeats as R


def brute(texts):
    """(sha of the text, n_bytes, n_removed, n_spans, sha of what is kept), in the order of documents."""
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def built(seed):
    """Passages shared, shifted, nested, cut and repeated within a text."""
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = [part(rng.choice([99, 100, 101, 150, 400])) for _ in range(8)]
    texts = []
    for i in range(60):
        pieces = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(0, 30)
            pieces.append(rng.choice([part(rng.randrange(200)), s, s[a:], s[: len(s) - a], part(3) * 60]))
        texts.append((i, "".join(pieces)))
    return texts


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(R, "HOT_BATCH", 2)
        monkeypatch.setattr(R, "HOT_BUCKET", 2)
    texts = built(seed)
    got = [tuple(r) for r in R.deduplicated(frame(spark, texts)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()]
    assert got == brute(texts)


def test_awkward_documents(spark):
    texts = awkward()
    got = sorted(tuple(r) for r in R.deduplicated(frame(spark, texts)).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(x[1:] for x in brute(texts))
    assert R.deduplicated(frame(spark, [])).count() == 0


def test_groups_are_maximal_repeats():
    rng = random.Random(5)
    part = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    core = part(110)
    segments = [part(2) + b"A" + core + b"B" + part(4), part(7) + b"C" + core + b"D" + part(1), core[5:] + b"E" + part(8), part(1) + b"F" + core[:104] + b"G" + part(3)]
    found = R.Repeats(np.arange(4), np.zeros(4, int), segments).groups()
    whole = [(length, {segments[k][s : s + length] for k, s in members}, sorted(members)) for length, members in found]
    assert all(len(strings) == 1 and len(members) > 1 for _, strings, members in whole)
    for length, strings, members in whole:  # all occurrences, not just neighbours
        s = next(iter(strings))
        assert members == sorted((k, i) for k, seg in enumerate(segments) for i in range(len(seg) - length + 1) if seg[i : i + length] == s)
    assert sorted((n, m) for n, _, m in whole) == [(104, [(0, 3), (1, 8), (3, 2)]), (105, [(0, 8), (1, 13), (2, 0)]), (110, [(0, 3), (1, 8)])]

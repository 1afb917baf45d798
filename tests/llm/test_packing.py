import random
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from data import awkward, frame
from tokenizers import Tokenizer

from filewright.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["it's 'tis we've DON'T ''s", " lead  and\n\n trail ", "<|endoftext|>", "a <|startoftext|> b", "ÀÉß µ ª×÷ x\x85y\xa0z", "1234 a1b2 ½ ²", "é ö ｆｕｌｌ", "日本語 テキスト", "x\x1cy", "İI ΣΑΣ"]


@pytest.mark.parametrize("memo", [0, 100_000])
def test_encoder_equals_the_library(library, memo):
    texts = [t or "" for _, t in awkward()] + ODD
    encode = P.WordBpe(PATH, 0, memo)
    for _ in range(2):
        ids, lengths = encode(texts)
        expected = [library(t) + [0] for t in texts]
        assert ids.tolist() == [i for e in expected for i in e] and lengths.tolist() == list(map(len, expected))


@pytest.mark.parametrize("chars", [1, 7, 50])
def test_slices_change_nothing(library, monkeypatch, chars):
    monkeypatch.setattr(P, "CHARS", chars)
    texts = ODD + ["a b\nc d  e  ", "x" * 300, "e ́ á b"]
    assert [x.tolist() for x in P.encoded(iter(texts), P.WordBpe(PATH, 0))] == [library(t) + [0] for t in texts]


def sequential(lengths, capacity):
    """Number of sequences of best-fit decreasing, one piece after the other."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice((1, 5, 20, 64))
    counts = {n: rng.choice((1, 2, 7, 40)) for n in range(1, capacity + 1) if rng.random() < 0.6}
    plan = P.best_fit(counts, capacity)
    placed, slots = defaultdict(list), defaultdict(set)
    for length, first, n, each, sequence, at in plan:
        assert n % each == 0
        for k in range(n):
            assert first + k not in slots[length]
            slots[length].add(first + k)
            placed[sequence + k // each].append((at + (k % each) * length, length))
    assert {n: set(range(c)) for n, c in counts.items()} == dict(slots)
    for own in placed.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= capacity
    assert len(placed) == sequential([n for n, c in counts.items() for _ in range(c)], capacity)


def test_plan_is_small_whatever_the_counts():
    rng = random.Random(2)
    few, many = ({n: f * rng.randrange(1, 50) for n in range(1, 2049)} for f in (1, 10**9))
    assert len(P.best_fit(few, 2048)) < 50_000 and len(P.best_fit(many, 2048)) < 50_000


def test_packed(spark, library):
    texts = awkward()
    capacity = 64
    got = P.packed(frame(spark, texts).repartition(5), partial(P.word_bpe, PATH, 0), capacity, with_ids=True)
    rows = got.collect()
    # the pieces are the documents' ids in order
    for r in rows:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == r.piece * capacity
    assert sorted((repr(r.doc_id), r.piece, tuple(r.ids)) for r in rows) == sorted((repr(i), k, tuple(ids[k * capacity : (k + 1) * capacity])) for i, ids in ((i, library(t) + [0]) for i, t in texts) for k in range(-(-len(ids) // capacity)))
    # no gaps and no overlaps, and as few sequences as best fit takes
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(sequences) == sequential([r.length for r in rows], capacity)
    whole = {r.sequence_id: r.ids for r in P.sequences(got).collect()}
    assert all(whole[k] == [i for r in sorted(parts, key=lambda r: r.offset) for i in r.ids] for k, parts in sequences.items())


def test_empty_and_query(spark, sf_dir, library):
    assert P.packed(frame(spark, []), partial(P.word_bpe, PATH, 0), 64).collect() == []
    got = defaultdict(list)
    for r in P.op12_best_fit_packing(spark, sf_dir).collect():
        got[r.doc_id].append(r)
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(library(d.text) + [0], "<u4")
        own = sorted(got[d.doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]

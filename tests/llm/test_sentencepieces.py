import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from data import awkward, frame

from filewright.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(model, monkeypatch):
    rng = random.Random(2)
    texts = [t or "" for _, t in awkward()]
    texts += ["  a  b ", "\n\nx\ty", "é𝔘 日本語", "it's don't (foo), bar... -- $%^ &&&", "a" * 300, "x     y      z", "def f(x): return {'a': 1}", "naïve façade – “quotes” …", "ﬁ", "<s> </s> <0x0A>"]
    texts += ["".join(rng.choice("abcdehiorst  .,'-\n") for _ in range(rng.randrange(80))) for _ in range(3000)]
    for memo in (S.MEMO, 10):
        monkeypatch.setattr(S, "MEMO", memo)
        encoder = S.Encoder(PATH)
        for _ in range(2):
            got = encoder(texts)
            for t, ids in zip(texts, got, strict=True):
                assert ids.tolist() == model.encode(t), t
                assert encoder.decode(ids) == model.decode(model.encode(t)) == t


def test_long_segments_equal_the_library(model):
    """Unbroken text of thousands of characters takes the same way."""
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (129, 1000, 5000)] + ["a" * 2000, "ab" * 900, "=" * 700, "the" * 500, "".join(rng.choice("ethaino") for _ in range(4000)), "日本語の文章" * 200]
    encoder = S.Encoder(PATH)
    for t, ids in zip(texts, encoder(texts), strict=True):
        assert ids.tolist() == model.encode(t), t[:50]


def test_query_columns(spark, sf_dir, model):
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = S.op5_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(model.encode(docs[r.doc_id]), "<u4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and r.round_trip


def test_suffix_array_finds_every_occurrence():
    pieces = S.Pieces(PATH)
    encoder = S.Encoder(PATH)
    text = pieces.char[[ord(c) for c in "▁the▁other▁there▁thing"]]
    place, piece = encoder._edges(text)
    whole = "▁the▁other▁there▁thing"
    expected = {(i, k) for k, p in enumerate(pieces.order) for i in range(len(whole)) if whole.startswith(p, i)}
    assert set(zip(place.tolist(), piece.tolist(), strict=True)) == expected


def test_rows(spark, model):
    texts = awkward()
    rows = S.encode(frame(spark, texts), PATH).collect()
    crc = sorted(zlib.crc32(np.array(model.encode(t or ""), "<u4").tobytes()) for _, t in texts)
    assert sorted(r.ids_crc32 for r in rows) == crc and all(r.round_trip and len(r.ids) == r.n_ids for r in rows)
    back = S.decode(S.encode(frame(spark, texts), PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in texts)
    assert S.encode(frame(spark, []), PATH).count() == 0


def test_batches_are_bounded(model, monkeypatch):
    """New segments in several turns give the library's ids, and memory doesn't grow with the texts that one call gets."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghilmnoprstuvwxyz") for _ in range(rng.randrange(4, 12))) for _ in range(60_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(450)]
    encoder = S.Encoder(PATH)
    tracemalloc.start()
    got = encoder(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(ids.tolist() == model.encode(t) for t, ids in zip(texts, got, strict=True))
    assert peak < 100 << 20, peak >> 20
    monkeypatch.setattr(S, "NEW_CHARS", 500)
    assert all(np.array_equal(a, b) for a, b in zip(S.Encoder(PATH)(texts[:2]), got, strict=False))

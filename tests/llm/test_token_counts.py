from collections import Counter
from functools import partial

import public_tokenizers
import sentencepiece
from data import awkward, frame
from tokenizers import Tokenizer

from filewright.llm.common import shared_dir
from filewright.llm.token_counts import TokenLedger, byte_bpe, op9_token_counts, pieces, signed, token_counts

VERSIONS = {"bpe": partial(byte_bpe, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "piece": partial(pieces, public_tokenizers.path("piece_bpe_32k.model"))}


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.totals().collect()}


def expected(texts, names):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    count = {"bpe": lambda t: len(bpe.encode(t, add_special_tokens=False).ids), "piece": lambda t: len(model.encode(t))}
    out = Counter()
    for source, lang, text in texts:
        for name in names:
            n = out.get((source, lang, name), (0, 0))
            out[source, lang, name] = (n[0] + 1, n[1] + count[name](text or ""))
    return dict(out)


def test_batches(spark):
    texts = awkward()
    df = frame(spark, texts).selectExpr("text", "if(doc_id % 2 = 0, 'a', null) as source", "lang", "'x' as tokens", "1 as sign")
    rows = [("a" if i is not None and i % 2 == 0 else None, "en", t) for i, t in texts]
    counts = token_counts(df, VERSIONS)
    ledger = TokenLedger(spark, shared_dir(spark, "ledger"))
    assert totals(ledger) == {}
    assert ledger.commit("a", signed(counts, "bpe"))
    assert not ledger.commit("a", signed(counts, "bpe"))  # sent again
    assert totals(ledger) == expected(rows, ["bpe"])
    assert ledger.commit("revised", signed(counts, "bpe", -1).unionByName(signed(counts, "piece")))
    assert totals(ledger) == expected(rows, ["piece"])
    odd = token_counts(df.where("source is null"), VERSIONS)
    assert ledger.commit("deleted", signed(odd, "piece", -1))
    assert ledger.commit("nothing", signed(counts.limit(0), "bpe"))
    assert totals(TokenLedger(spark, ledger.folder)) == expected([r for r in rows if r[0]], ["piece"])


def test_fold(spark):
    """Totals stay as they are over folds, batches that are sent again, and a mark that another writer has put in between."""
    rows = spark.createDataFrame([("a", "en", "t", 5, 1), ("a", None, "t", 7, 1), ("b", "en", "t", 2, 1)], "source string, lang string, tokenizer string, tokens long, sign int")
    ledger = TokenLedger(spark, shared_dir(spark, "ledger"))
    assert ledger.fold() and totals(ledger) == {}
    assert ledger.commit("1", rows) and ledger.commit("2", rows.where("source = 'a'"))
    expected = {("a", "en", "t"): (2, 10), ("a", None, "t"): (2, 14), ("b", "en", "t"): (1, 2)}
    assert totals(ledger) == expected
    assert ledger.fold() and totals(ledger) == expected
    assert not ledger.commit("1", rows) and totals(ledger) == expected
    assert ledger.commit("3", rows.where("source = 'b'").selectExpr("source", "lang", "tokenizer", "tokens", "-sign as sign"))
    del expected["b", "en", "t"]
    before = ledger._fs.listStatus(ledger._path(f"{ledger.folder}/deltas"))
    assert totals(ledger) == expected and ledger.fold() and totals(ledger) == expected
    assert len(ledger._fs.listStatus(ledger._path(f"{ledger.folder}/deltas"))) == len(before) - 2  # those of the base before
    assert ledger.fold() and ledger.fold() and totals(ledger) == expected
    other = TokenLedger(spark, ledger.folder)
    assert other._publish(other._mark("4"), "attempt of a writer that is dead") and not ledger.commit("4", rows) and totals(ledger) == expected


def test_writers_of_one_batch(spark, monkeypatch):
    """Two drivers that both see no mark: one attempt counts, and nothing else is in the way."""
    rows = spark.createDataFrame([("a", "en", "t", 5, 1)], "source string, lang string, tokenizer string, tokens long, sign int")
    one = TokenLedger(spark, shared_dir(spark, "ledger"))
    two = TokenLedger(spark, one.folder)
    monkeypatch.setattr(two, "committed", lambda batch_id: False)
    assert one.commit("x", rows) and not two.commit("x", rows)
    assert totals(one) == totals(two) == {("a", "en", "t"): (1, 5)}


def test_query(spark, sf_dir):
    docs = [(d.source, d.lang, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in op9_token_counts(spark, sf_dir).collect()}
    assert {k[2] for k in got} == {"piece_bpe_32k", "byte_bpe_multi_50k"}
    piece = {(a, b, "piece_bpe_32k"): n for (a, b, _), n in expected(docs, ["piece"]).items()}
    assert {k: v for k, v in got.items() if k[2] == "piece_bpe_32k"} == piece

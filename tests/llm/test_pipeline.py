"""The pipeline over awkward documents: every stage against a brute-force version of its decision."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from data import COLUMNS, awkward, rows, words
from test_near_dedup import shingles, similarity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from filewright.llm import near_dedup as D  # noqa: E402
from filewright.llm import toxicity as T  # noqa: E402
from filewright.llm.common import staged  # noqa: E402

ITEM = "Who of them first saw the long river behind the old mill that nobody had ever named before the war"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, path = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    base = words(rng, 120, 3000).split()
    texts = [(1000 + i, words(rng, rng.randrange(20, 90), 3000)) for i in range(150)] + awkward()
    texts += [(2000 + i, words(rng, 40, 3000) + " vexgru" + rng.choice("mnop") + "a vexgruis") for i in range(60)]
    for i in range(6):
        w = list(base)
        w[20 * i] = f"edit{i}"
        texts.append((3000 + i, " ".join(w)))
    texts += [(4000, texts[0][1].upper()), (4001, words(rng, 30, 3000) + " " + ITEM + " " + words(rng, 30, 3000))]
    spark.createDataFrame(rows(texts), COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(2000 <= i < 3000)) for i, _ in texts if i is not None and i >= 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def kept_rows(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_stages_against_brute_force(spark, tables):
    path, texts = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    # toxicity: the rows below the threshold, and of the planted ones most are gone
    one = staged(stages["toxicity"](spark, docs, path), "test")
    score = {(r.doc_id, r.text): r.s for r in T.score(docs, T.train(docs, spark.read.parquet(f"{path}/labels.parquet")), ["doc_id", "text"], score_column="s").collect()}
    assert kept_rows(one) == sorted((i is not None, i or 0, t or "") for i, t in texts if score[i, t] < T.THRESHOLD)
    toxic = [i for i, _ in texts if i is not None and 2000 <= i < 3000]
    assert sum(r.doc_id in set(toxic) for r in one.collect()) < 0.1 * len(toxic) and one.count() > len(texts) - len(toxic) - 5
    # exact dedup: one row a text, that with the largest id
    two = staged(stages["exact_dedup"](spark, one, path), "test")
    best: dict = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in one.collect():
        key = (r.text or "").translate(lower)
        best[key] = max(best.get(key, (False, 0)), (r.doc_id is not None, r.doc_id or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in two.collect()) == sorted(best.values())
    # near dedup: one row of each class of links
    three = staged(stages["near_dedup"](spark, two, path), "test")
    left = [r.text or "" for r in two.collect()]
    idf = np.asarray(D.open_array(D.inverse_frequencies(two), "idf", "<f4"))
    sets = [shingles(t, idf) for t in left]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(left)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= D.SIMILARITY:
                root[find(i)] = find(j)
    assert len({find(left.index(r.text or "")) for r in three.collect()}) == three.count() == len({find(i) for i in range(len(left))})
    # decontamination: the document with the item goes
    four = staged(stages["decontamination"](spark, three, path), "test")
    assert kept_rows(four) == [x for x in kept_rows(three) if ITEM not in x[2]] and four.count() == three.count() - 1
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    # encoding: the library's ids
    five = stages["sentencepiece"](spark, four, path).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted(zlib.crc32(np.array(model.encode(r.text or ""), "<u4").tobytes()) for r in four.collect())
    assert sorted(r.ids_crc32 for r in five) == expected


def test_run_and_empty_table(spark, tables, tmp_path):
    path, _ = tables
    assert corpus_pipeline.run(spark, path).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

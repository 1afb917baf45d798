import hashlib
import random

from data import awkward, frame

from filewright.llm import exact_dedup as E


def plain(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_cuckoo_index_against_a_dict():
    rng, index, model = random.Random(3), E.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for n in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.35:
            assert index.delete(k) == (model.pop(k, None) is not None)
        else:
            index.put(k, n)
            model[k] = n
        if n % 50 == 0:
            q = rng.choice(keys)
            assert index.get(q) == model.get(q)
    assert dict(index.items()) == model and index.size == len(model)


def test_false_hits_are_verified():
    index = E.CuckooIndex(4)
    index.put(b"12345678" + b"a" * 24, 1)
    assert index.get(b"12345678" + b"b" * 24) is None
    index.put(b"12345678" + b"b" * 24, 2)
    assert index.get(b"12345678" + b"a" * 24) == 1


def test_groups(spark):
    texts = awkward() + [(i, "hot TEXT") for i in range(1000, 3000)]
    got = E.exact_groups(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    groups = {}
    for i, t in texts:
        groups.setdefault(plain(t), []).append(i)
    by_digest = {hashlib.sha256(k.encode()).digest(): v for k, v in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_dedup_keeps_columns(spark):
    df = frame(spark, awkward())
    kept = E.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len({plain(t) for _, t in awkward()})
    assert E.exact_dedup(frame(spark, [])).count() == 0


def test_retire(spark):
    rows = E.staged(E.digests(frame(spark, awkward())), "t")
    index = E.staged(E.build_index(rows), "t")
    gone = index.orderBy("digest").limit(5)
    left = E.retire(index, gone)
    assert left.count() == index.count() - 5 and left.join(gone, "digest").count() == 0

import random

import pytest

from filewright.llm.url_filters import RULES, judge

RULE = "host string, path string, verdict string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), h.count(".") + 1, h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(["a", "b", "bb", "net", "é"]) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/", "/x", "/x/", "/x/y", "/z"])
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path() or "/") for _ in range(40))}.values())
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host()}{path()}{rng.choice(['', '?q=/x', '#x', '/'])}" for _ in range(800)]
    urls += [None, "", "nothing", "://", "http://", "http://A.NET", "http://a.net?x://b/", "http://net.", "a://b://c/x"] + ["http://a.net/x"] * 300
    pages = spark.createDataFrame([(i if i % 7 else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = judge(pages, spark.createDataFrame(rules, RULE)).collect()
    key = lambda t: tuple((x is not None, x or "") for x in t)
    assert sorted((key(r[1:]) for r in got)) == sorted(key(brute(u, rules)) for u in urls)


def test_given_rules_and_empty_tables(spark):
    urls = {"http://x.net": None, "http://x.net/": "net/", "http://www.example.net/en/1": "example.net/en/", "http://example.com/de/": "example.com/de/", "http://notexample.com/de/": None, "http://a.org/fr/x": "org/fr/", "http://a.org/fr": None}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, RULE)
    assert {list(urls)[r.page_id]: r.rule for r in judge(pages, rules).collect()} == urls
    assert judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge(pages, rules.limit(0)).collect()} == {"allow"}

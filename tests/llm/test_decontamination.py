import random
import re

from data import awkward, frame, words

from filewright.llm.decontamination import ENOUGH, SLOTS, UNITS, WINDOW, decontaminate, leaks

ITEM = "item_id long, text string"


def template(text):
    """(template words, values) by plain Python."""
    text = re.sub(r"(?<=[^\W_] |[,;:] )(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])", "\x01", text)
    if re.search(r"\d", text):
        text = re.sub(r"(?<=\d)[.,](?=\d)", "\x03", text)
        text = re.sub(rf"(?i)(\d) ?({UNITS})(?![^\W_])", "\\1 \x02\\2", text)
    values = [w for w in re.split("[^\\w%€£\x01\x02\x03]+|_", text.lower()) if w]
    kind = lambda w: w[0] if w[0] in "\x01\x02" else re.sub("^\\d[\\d\x03]*$", "\x04", w)
    return [kind(w) for w in values], values


def brute(text, item):
    """Matched windows of the item in the text."""
    (a, av), (b, bv) = template(text), template(item)
    slots = lambda j: [k for k in range(j, j + WINDOW) if b[k] != bv[k]]
    windows = len(b) - WINDOW + 1
    plain = {j for j in range(windows) if len(slots(j)) <= SLOTS}
    found = [(i, j) for i in range(len(a) - WINDOW + 1) for j in range(windows) if a[i : i + WINDOW] == b[j : j + WINDOW]]
    found = [(i, j) for i, j in found if any(i - j == x - y for x, y in found if y in plain)]  # vague ones on the others' alignments
    stands: dict = {}
    for i, j in found:
        for k in slots(j):
            stands.setdefault((i - j, bv[k]), set()).add(av[k + i - j])
    kept = {(i, j) for i, j in found if all(len(stands[i - j, bv[k]]) == 1 for k in slots(j))}

    def held(i, j):
        for step in (-1, 1):
            x, y = i, j
            while (x, y) in kept:
                if y in plain:
                    return True
                x, y = x + step, y + step
        return False

    good = {j for i, j in kept if held(i, j)}
    return (len(good), windows) if plain and len(good) >= min(ENOUGH, -(-windows // 2)) else None


QUESTION = "If Anna buys 12 apples and gives 5 kg of them to Bob, and then Anna sells 12 more, how many does she have left?"
CASES = [
    QUESTION,
    "Before. " + QUESTION.replace("Anna", "Clara").replace("12", "1,300").replace("5 kg", "7.5 miles").replace("Bob", "Eve") + " After.",
    QUESTION.replace("Anna buys", "Anna buys").replace("Anna sells 12", "Zoe sells 99"),
    "nothing of the kind is said here, as anyone can see at once",
    QUESTION.upper(),
]


def test_reparameterised_questions(spark):
    items = [(1, QUESTION), (2, "too short"), (3, None), (None, words(random.Random(3), 30))]
    texts = list(enumerate(CASES)) + [(20, "x " + items[3][1] + " y"), (20, items[3][1])] + [(i + 100 if i is not None else None, t) for i, t in awkward()]
    df = frame(spark, texts)
    got = sorted((r.row, r.item_id is None, r.matched, r.windows) for r in leaks(df, spark.createDataFrame(items, ITEM)).collect())
    numbers = [r["row"] for r in df.selectExpr("monotonically_increasing_id() as row").collect()]
    expected = [(n, i is None, *found) for n, (_, t) in zip(numbers, texts, strict=True) for i, item in items if (found := brute(t or "", item or ""))]
    assert got == sorted(expected)
    by_case = {n: k for k, n in enumerate(numbers)}
    assert {by_case[r[0]] for r in got} >= {0, 1, 5, 6} and 3 not in {by_case[r[0]] for r in got}


def test_large_benchmarks_take_the_other_way(spark, monkeypatch):
    import filewright.llm.decontamination as M

    rng = random.Random(8)
    items = [(i, words(rng, 20)) for i in range(30)]
    df = frame(spark, [(i, words(rng, 10) + " " + items[i][1]) for i in range(30)] + [(99, words(rng, 50))])
    benchmark = spark.createDataFrame(items, ITEM)
    one = sorted(map(tuple, leaks(df, benchmark).collect()))
    monkeypatch.setattr(M, "CONSTANTS", 3)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, leaks(df, benchmark).collect())) == one and len(one) == 30
    assert decontaminate(df, benchmark).columns == df.columns and [r.doc_id for r in decontaminate(df, benchmark).collect()] == [99]


def test_items_of_values_short_items_and_other_capitals(spark):
    values, names = "Compute 12 x 7 + 30 - 4", "We met Anna Berg, Bob Cole, Cleo Dahl, Dora Ehm and Emil Falk"
    benchmark = spark.createDataFrame([(1, values), (2, names), (3, "Who wrote Faust?")], ITEM)
    texts = ["so: " + values + " now", "Well. Compute 13 x 8 + 31 - 5 now", "then " + names.lower(), names.upper() + " again", "and who wrote faust then", "Compute 5 apples and nothing else at all here", "who wrote it"]
    df = frame(spark, list(enumerate(texts)))
    ids = {r.n: r.doc_id for r in df.selectExpr("monotonically_increasing_id() as n", "doc_id").collect()}
    assert sorted((ids[r.row], r.item_id) for r in leaks(df, benchmark).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


MIXED = "Compute 12 x 7 + 30 - 4 for the sake of it"


def test_vague_windows_count_beside_others(spark):
    """An item with plain and vague windows: a copy with other values has all of them; its plain end alone is no leak."""
    benchmark = spark.createDataFrame([(1, MIXED)], ITEM)
    texts = ["I paid 20 for the sake of it", MIXED, "so compute 13 x 9 + 31 - 6 for the sake of it all", "Compute 1 x 2 + 3 - 4 as you like, for the sake of nothing", "7 8 for the sake of it"]
    df = frame(spark, list(enumerate(texts)))
    ids = {r.n: r.doc_id for r in df.selectExpr("monotonically_increasing_id() as n", "doc_id").collect()}
    got = {(ids[r.row], r.matched, r.windows) for r in leaks(df, benchmark).collect()}
    assert got == {(i, *found) for i, t in enumerate(texts) if (found := brute(t, MIXED))} and {i for i, _, _ in got} == {1, 2}


def test_very_short_items_leak_only_as_whole_texts(spark):
    benchmark = spark.createDataFrame([(1, "the"), (2, "one of the"), (3, "Who wrote Faust?")], ITEM)
    texts = ["the one of the many", "The.", "One, of the!", "so who wrote faust then", "Who wrote Faust?", ""]
    df = frame(spark, list(enumerate(texts)))
    ids = {r.n: r.doc_id for r in df.selectExpr("monotonically_increasing_id() as n", "doc_id").collect()}
    assert sorted((ids[r.row], r.item_id) for r in leaks(df, benchmark).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]


def test_empty_tables(spark):
    df, benchmark = frame(spark, awkward()), spark.createDataFrame([(1, QUESTION)], ITEM)
    assert decontaminate(df, benchmark.limit(0)).count() == df.count()
    assert decontaminate(frame(spark, []), benchmark).count() == 0

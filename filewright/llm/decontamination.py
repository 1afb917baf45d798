"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become templates: names (a capitalised word inside a sentence), numbers (with decimal and thousands marks) and the units
after them turn into one placeholder a kind, everything else into lower-case words. Windows of ``WINDOW`` template words of
the documents meet those of the benchmark in a hash join. A window that holds placeholders counts only if its slots are consistent: on one
alignment of a document with an item, each value of the item's slots must stand for one value in the document. So a
question with other numbers, names or units is found, and chance agreement of placeholders isn't.

Windows of an item with more than ``SLOTS`` placeholders say little by themselves. In an item that has others, such a window counts where it matches
next to windows that count, in one run on one alignment; it is looked for only there. An item that has no others leaks where all its windows
match on one alignment with consistent slots. Otherwise an item leaks into a document if ``ENOUGH`` of its windows match, or half of all its windows where it has fewer
than twice as many.

Beside templates, literal windows of lower-case words are matched by the same count: they find copies in other capitals and of items that are mostly
values. An item of fewer than ``WINDOW`` words is one literal window if it has ``SHORT_WORDS`` words and ``SHORT_LETTERS`` characters; a shorter one ("the") leaks only into a
document that holds nothing else. ``matched`` and ``windows`` are the template's where that finds the item, else the literal windows'.

Up to ``CONSTANTS`` windows of a benchmark are looked up inside each text's array of windows, so that only those that
match become rows; a larger benchmark meets all windows as rows. The benchmark's windows are broadcast up to ``BROADCAST_ROWS`` rows and joined by a shuffle beyond; so are the rows to
drop. Documents are read once for templates and once for literal windows, and again only where matched windows hold placeholders.

Defined results: null and empty texts match nothing; repeated rows match
alike; items with equal texts each match; empty tables give no rows; other columns are ignored. A frame that isn't a
scan is written once, so that rows keep their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.llm.common import numbered, repeatable, staged, table, text_or_empty

WINDOW, ENOUGH = 5, 9
#: Placeholders from which more make a window vague.
SLOTS = 2
#: Of items below WINDOW words: words and characters that are looked for inside of texts.
SHORT_WORDS, SHORT_LETTERS = 3, 12
BROADCAST_ROWS = 1_000_000
#: Benchmark windows that are also looked up before texts are taken apart.
CONSTANTS = 20_000
#: Units that may follow a number.
UNITS = "kilometers|kilometres|kilograms|centimeters|millimeters|meters|metres|grams|liters|litres|hours|minutes|seconds|days|weeks|months|years|dollars|euros|pounds|cents|percent|degrees|miles|inches|feet|km|kg|cm|mm|mg|ml|mph|usd|eur|gb|mb|hz|m|g|l|h|s|%|€|£"
NAME, UNIT, POINT, NUMBER = "\x01", "\x02", "\x03", "\x04"


def _marked(df: DataFrame, row: str, text: Column) -> DataFrame:
    """row, marked: the text in lower case with a mark before names and units, and with decimal marks made part of the number.

    Each step is a projection of its own, which Spark keeps apart from the next, so that nothing is worked out twice.
    """
    named = df.select(row, F.regexp_replace(text, r" (?<=[\p{L}\p{N},;:] )(?=\p{Lu}\p{Ll})", f" {NAME}").alias("named"))
    digits = F.regexp_replace(F.col("named"), r"(?<=\d)[.,](?=\d)", POINT)
    digits = F.regexp_replace(digits, rf"(?i)(\d) ?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    return named.select(row, F.when(F.col("named").rlike(r"\d"), digits).otherwise(F.col("named")).alias("m")).select(row, F.lower("m").alias("marked"))


def _words(marked: Column) -> Column:
    return F.array_remove(F.split(marked, rf"[^\p{{L}}\p{{M}}\p{{N}}%€£{NAME}{UNIT}{POINT}{NUMBER}]+"), "")


def _templates(df: DataFrame, row: str, text: Column) -> DataFrame:
    """row, marked, template: placeholders in place of the marked names and units, and of numbers; words stay in their places."""
    marked = _marked(df, row, text)
    named = F.regexp_replace("marked", rf"{NAME}[\p{{L}}\p{{M}}\p{{N}}]+", NAME)
    plain = marked.select(row, "marked", F.when(F.contains("marked", F.lit(NAME)), named).otherwise(F.col("marked")).alias("p"))
    digits = F.regexp_replace(F.regexp_replace("p", rf"{UNIT}[\p{{L}}%€£]+", UNIT), rf"(?<![\p{{L}}\p{{M}}\p{{N}}{POINT}])\p{{N}}[\p{{N}}{POINT}]*(?![\p{{L}}\p{{M}}])", NUMBER)
    return plain.select(row, "marked", F.when(F.col("p").rlike(r"\p{N}"), digits).otherwise(F.col("p")).alias("template"))


def _window_hashes(df: DataFrame, row: str, text: Column) -> DataFrame:
    """row, w: the hashes of the template's windows; empty for texts of fewer words.

    No filter stands above these projections: it would be pushed below them and work everything out again.
    """
    words = _templates(df, row, text).select(row, _words(F.col("template")).alias("words"))
    hashes = words.select(row, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    places = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - WINDOW)).otherwise(F.expr("array_repeat(0, 0)"))
    return hashes.select(row, F.transform(places, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])).alias("w"))


def _literal_hashes(df: DataFrame, row: str, text: Column, short: list[int] | None = None) -> DataFrame:
    """row, w: the hashes of the literal windows, and of those of the lengths in ``short``; of a short text also that of the whole text.

    Without ``short``, a text of fewer than ``WINDOW`` words is one window, or, if it is very short, only the whole text.
    """
    words = _marked(df, row, text).select(row, _words(F.translate("marked", NAME + UNIT, "")).alias("words"))
    hashes = words.select(row, F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.length(F.array_join("words", "")).alias("letters"))

    def of(size: int) -> Column:
        places = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.expr("array_repeat(0, 0)"))
        return F.transform(places, lambda i: F.xxhash64(F.lit(size), *[F.get("h", i + k) for k in range(size)]))

    def only(size: int) -> Column:
        """The window of a text of just so many words."""
        return F.array(F.xxhash64(F.lit(-size), *[F.get("h", F.lit(k)) for k in range(size)]))

    whole = F.expr("cast(array() as array<bigint>)")
    for n in range(1, WINDOW):
        whole = F.when(F.size("h") == n, only(n)).otherwise(whole)
    if short is not None:
        return hashes.select(row, F.concat(*[of(n) for n in (WINDOW, *short)], whole).alias("w"))
    inside = of(WINDOW)
    for n in range(SHORT_WORDS, WINDOW):
        inside = F.when((F.size("h") == n) & (F.col("letters") >= SHORT_LETTERS), of(n)).otherwise(inside)
    return hashes.select(row, F.when(F.size("h").between(1, WINDOW - 1) & ((F.size("h") < SHORT_WORDS) | (F.col("letters") < SHORT_LETTERS)), whole).otherwise(inside).alias("w"))


def _bitmap(hashes: list[int]) -> tuple[Column, int]:
    """A constant array of 64-bit words with a bit set for each hash, and the number of words; folded once by the optimizer."""
    size = 1 << max(10, len(hashes).bit_length())
    words = [0] * size
    for h in hashes:
        words[(h >> 6) & (size - 1)] |= 1 << (h & 63)
    signed = ",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)
    return F.split(F.lit(signed), ",").cast("array<bigint>"), size


def _windows(hashed: DataFrame, row: str, known: list[int] | None = None) -> DataFrame:
    """row, at, window (hash) of every window of ``hashed`` (row, w), or of those that may be in ``known``."""
    if known is None:
        return hashed.select(row, F.posexplode_outer("w").alias("at", "window")).where("at is not null")
    bits, size = _bitmap(known)

    def may_be_known(i: Column) -> Column:
        h = F.get("w", i)
        word = F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(size - 1)).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    places = F.filter(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)), may_be_known)
    spots = hashed.select(row, "w", places.alias("places")).select(row, "w", F.explode_outer("places").alias("at")).where("at is not null")
    return spots.select(row, "at", F.get("w", F.col("at")).alias("window"))


def _slots(df: DataFrame, row: str, text: Column) -> DataFrame:
    """row, place, value of the words that a template replaces."""
    both = _templates(df, row, text).select(row, F.posexplode_outer(F.arrays_zip(_words(F.col("marked")).alias("value"), _words(F.col("template")).alias("word"))).alias("place", "p"))
    return both.where("p.value <> p.word").select(row, "place", F.col("p.value").alias("value"))


def _sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast only if it is small enough; ``df`` is a written table, so its count is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _found(hashed: DataFrame, known: DataFrame) -> DataFrame:
    """row, at, item, item_at of the texts' windows (row, w) that are in ``known``, a written table."""
    # a small benchmark is also a constant bitmap, so that only windows that may match leave their text
    few = known.select("window").distinct().limit(CONSTANTS + 1).collect()
    asked = _windows(hashed, "row", [x.window for x in few] if len(few) <= CONSTANTS else None)
    return asked.join(_sized(known), "window").select("row", "at", "item", "item_at")


def _judged(matches: DataFrame, known: DataFrame) -> DataFrame:
    """row, item, matched, windows where enough of an item's windows match.

    They match anywhere in the document; partial counts come first, so a window repeated often is one row.
    """
    matched = matches.groupBy("row", "item", "item_at").agg(F.count("*").alias("n")).groupBy("row", "item").agg(F.count("*").alias("matched"))
    sizes = known.groupBy("item").agg(F.count("*").alias("windows"))
    enough = F.least(F.lit(ENOUGH), F.ceil(F.col("windows") / 2))
    return matched.join(sizes, "item").where(F.col("matched") >= enough).select("row", "item", "matched", "windows")


def _literal(rows: DataFrame, items: DataFrame) -> DataFrame:
    """row, item, matched, windows of the items that leak literally."""
    known = staged(_windows(_literal_hashes(items, "item", F.col("item_text")), "item").withColumnRenamed("at", "item_at"), "literal_windows")
    sizes = _marked(items, "item", F.col("item_text")).select(F.size(_words(F.translate("marked", NAME + UNIT, ""))).alias("n"))
    short = [x.n for x in sizes.where(F.col("n").between(SHORT_WORDS, WINDOW - 1)).distinct().collect()]
    return _judged(_found(_literal_hashes(rows, "row", F.col("text"), sorted(short)), known), known)


def leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_text_column: str = "text", item_id_column: str = "item_id") -> DataFrame:
    """row (its number), item_id, matched, windows: the items that leak into each document."""
    docs, row = numbered(repeatable(docs))
    rows = docs.select(F.col(row).alias("row"), text_or_empty(text_column).alias("text"))
    items = staged(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id_column).alias("item_id"), text_or_empty(item_text_column).alias("item_text")), "items")
    own = staged(_slots(items, "item", F.col("item_text")).withColumnRenamed("value", "item_value"), "item_slots")
    before = F.explode(F.array(*[F.col("place") - k for k in range(WINDOW)]))
    vague = own.select("item", before.alias("item_at")).groupBy("item", "item_at").agg(F.count("*").alias("n")).where(F.col("n") > SLOTS)
    every = _windows(_window_hashes(items, "item", F.col("item_text")), "item").withColumnRenamed("at", "item_at")
    marked = every.join(vague.withColumn("vague", F.lit(True)).drop("n"), ["item", "item_at"], "left").withColumn("vague", F.coalesce("vague", F.lit(False)))
    only = marked.groupBy("item").agg(F.min("vague").alias("only_vague"), F.count("*").alias("all_windows"))
    known = staged(marked.join(only, "item"), "item_windows")
    found = staged(_found(_window_hashes(rows, "row", F.col("text")), staged(known.where("only_vague or not vague"), "asked_windows")), "matches")
    beside = known.where("vague and not only_vague").select("item", F.col("item_at").alias("vague_at"), F.col("window").alias("vague_window"))
    if not beside.isEmpty():
        # vague windows are looked for on the alignments of the others
        aligned = staged(found.select("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct().join(_sized(beside), "item"), "vague_spots")
        again = _window_hashes(rows.join(_sized(staged(aligned.select("row").distinct(), "vague_rows")), "row", "left_semi"), "row", F.col("text"))
        at = F.col("vague_at") + F.col("shift")
        met = again.join(aligned, "row").where((at >= 0) & (F.get("w", at) == F.col("vague_window")))
        found = staged(found.unionByName(met.select("row", at.alias("at"), "item", F.col("vague_at").alias("item_at"))), "all_matches")
    # slots of both sides, for windows that hold a placeholder
    spots = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(WINDOW)]))).select("row", "item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", (F.col("item_at") + F.col("k")).alias("place"))
    spots = staged(spots.join(_sized(own), ["item", "place"]), "slot_pairs")
    inconsistent = None
    if not spots.isEmpty():
        asked = staged(spots.select("row").distinct(), "slot_rows")
        values = _slots(rows.join(_sized(asked), "row", "left_semi"), "row", F.col("text"))
        pairs = spots.withColumn("at_place", F.col("place") + F.col("shift")).join(values.withColumnRenamed("place", "at_place"), ["row", "at_place"])
        # each value of the item's slots must stand for one value on this alignment
        wrong = pairs.groupBy("row", "item", "shift", "item_value").agg((F.min("value") != F.max("value")).alias("wrong")).where("wrong")
        inconsistent = pairs.join(wrong, ["row", "item", "shift", "item_value"], "left_semi").select("row", "item", "shift", "item_at").distinct()
    matches = found.withColumn("shift", F.col("at") - F.col("item_at"))
    if inconsistent is not None:
        matches = matches.join(inconsistent, ["row", "item", "shift", "item_at"], "left_anti")
    # items of vague windows only must match as wholes on one alignment
    strict = _sized(staged(known.where("only_vague").select("item", "all_windows").distinct(), "vague_items"))
    whole = matches.join(strict, "item").groupBy("row", "item", "shift", "all_windows").agg(F.countDistinct("item_at").alias("n")).where("n = all_windows").select("row", "item", "shift")
    if not beside.isEmpty():
        # of a run on one alignment, vague windows count if another window is in it
        marks = matches.join(_sized(beside.select("item", F.col("vague_at").alias("item_at"), F.lit(True).alias("vague"))), ["item", "item_at"], "left").withColumn("plain", F.col("vague").isNull())
        run = F.col("item_at") - F.row_number().over(Window.partitionBy("row", "item", "shift").orderBy("item_at"))
        marks = marks.withColumn("run", run).withColumn("held", F.max("plain").over(Window.partitionBy("row", "item", "shift", "run")))
        matches = marks.where("held").drop("plain", "vague", "run", "held")
    matches = matches.join(strict, "item", "left_anti").select("row", "item", "item_at").unionByName(matches.join(whole, ["row", "item", "shift"], "left_semi").select("row", "item", "item_at"))
    by_template = staged(_judged(matches, known), "by_template")
    literal = staged(_literal(rows, items), "literal")
    judged = by_template.unionByName(literal.join(by_template, ["row", "item"], "left_anti"))
    return judged.join(items.select("item", "item_id"), "item").select("row", "item_id", "matched", "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    docs = repeatable(docs)
    rows, row = numbered(docs)
    gone = staged(leaks(docs, benchmark).select(F.col("row").alias(row)).distinct(), "leaking")
    return rows.join(_sized(gone), row, "left_anti").drop(row)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeatable(table(spark, sf_dir, "documents"))
    found = staged(leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")
    docs, row = numbered(docs)
    ids = docs.select(F.col(row).alias("row"), "doc_id")
    return ids.join(_sized(found), "row").select("doc_id", "item_id", "matched", "windows")

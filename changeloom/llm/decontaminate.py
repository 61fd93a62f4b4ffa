"""Benchmark passages in documents, also with other numbers, names and units.

Words (runs of anything but 0x20 and 0x09-0x0D) become a template: numbers,
capitalised names and units turn into typed placeholders, the rest is lower-cased. Windows
of ``WINDOW`` template words are hash-joined with those of the benchmark. In a window that
matches, the words behind the placeholders must be consistent: the same value in the item
always stands for the same value in the document. A document holds an item if, at any shifts,
consistent windows cover at least half of the item's windows.

Everything is DataFrame functions. Items shorter than a window are one window of
their own length. A window says too little as a template with fewer than ``SAYS`` literal words (one that is a whole item: with less than half of its
words literal): then it must match word by word, in lower case. So must items of fewer than ``LEAST`` words, anywhere in a
text; those of one or two words, which any text may hold by chance, only match a document that consists of them.

Null and empty texts match nothing, nor does anything match an empty table of either kind; rows that
repeat a document or an item give the same pair once; a null doc_id is kept as such, and rows that share a doc_id are
told apart by their texts. Extra columns are ignored. A text's words, marks and windows are arrays of one row, some
40 bytes a word while it is worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, held, is_small

WINDOW, LEAST, FEW, SAYS = 8, 5, 3, 2
BENCHMARK_ROWS = 500_000  # windows that may be broadcast (a few longs each)
TEMPLATE, LITERAL, WHOLE = 0, 1, 2  # what of a window must match

SPACE = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"
# fixed values: unit words, and capitalised words that are no names
UNITS = (
    "mm cm m km mg g kg ml l cl inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh watt watts volt volts"
).split()
NO_NAMES = "A An The In On At Of To For From By With If When While What Which Who Whom Whose Why Where How And Or But So Then There This That These Those It Is Are Was Were Be Do Does Did He She They We You I His Her Their Each Every All Some Find Given Suppose Let".split()

# patterns of a whole word; the same text serves other engines
NUMBER = r"[^\x20\x09-\x0D\p{L}0-9]*[0-9][^\x20\x09-\x0D\p{L}]*\p{L}{0,3}[^\x20\x09-\x0D\p{L}0-9]*"
UNIT = rf"[^\x20\x09-\x0D\p{{L}}0-9]*(?:{'|'.join(UNITS)})[^\x20\x09-\x0D\p{{L}}0-9]*"
NAME = r"[^\x20\x09-\x0D\p{L}0-9]*\p{Lu}\p{Ll}+[^\x20\x09-\x0D\p{L}0-9]*"
NO_NAME = rf"[^\x20\x09-\x0D\p{{L}}0-9]*(?:{'|'.join(NO_NAMES)})[^\x20\x09-\x0D\p{{L}}0-9]*"
MARKS = ("<num>", "<unit>", "<name>")


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""), rf"{SPACE}+")


def _marks(words: Column) -> Column:
    """The template words. Most words are small letters only, which a plain test and a lookup settle."""

    def is_a(w: Column, pattern: str) -> Column:
        return w.rlike(rf"^(?:{pattern})\z")

    def mark(w: Column) -> Column:
        odd = F.when(is_a(w, NUMBER), MARKS[0]).when(is_a(w, UNIT), MARKS[1]).when(is_a(w, NAME) & ~is_a(w, NO_NAME), MARKS[2]).otherwise(F.lower(w))
        return F.when(w.rlike("[^a-z]"), odd).when(w.isin(*UNITS), MARKS[1]).otherwise(w)

    return F.transform(words, mark)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(hashes: Column, at: Column, size: Column | int, form: Column | int) -> Column:
    """The key of a window: of its kind, its length and its words."""
    size, form = (F.lit(x) if isinstance(x, int) else x for x in (size, form))
    return F.xxhash64(form.cast("int"), size.cast("int"), F.slice(hashes, at + 1, size))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_t (hash of the text), size, form, item_at, hash and item_windows of all windows of all items."""
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_text is not null").distinct()
    items = items.withColumn("words", _words(F.col("item_text"))).withColumn("marks", _marks(F.col("words"))).withColumn("n", F.size("words")).where(F.get("words", F.lit(0)) != "")
    items = items.withColumn("size", F.when(F.col("n") < LEAST, F.col("n")).otherwise(F.least("n", F.lit(WINDOW))))
    spans = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    literal = F.size(F.filter(F.slice("marks", F.col("item_at") + 1, F.col("size")), lambda w: ~w.isin(*MARKS)))
    spans = spans.withColumn("form", F.when(F.col("n") < FEW, WHOLE).when(F.col("n") < LEAST, LITERAL).when(F.when(F.col("size") < WINDOW, 2 * literal >= F.col("size")).otherwise(literal >= SAYS), TEMPLATE).otherwise(LITERAL))
    words = F.when(F.col("form") == TEMPLATE, F.col("marks")).otherwise(F.transform("words", F.lower))
    found = spans.select("item_id", F.xxhash64("item_text").alias("item_t"), "size", "form", "item_at", _window(_hashes(words), F.col("item_at"), F.col("size"), F.col("form")).alias("hash"), (F.col("n") - F.col("size") + 1).alias("item_windows"))
    return held(found)


def _spans(docs: DataFrame, forms: list[tuple[int, int]]) -> DataFrame:
    """doc_id, t, at and hash of the documents' windows of the kinds and lengths asked for, all from one pass over the words."""
    words = docs.select("doc_id", F.xxhash64("text").alias("t"), _words(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "t", _hashes(_marks(F.col("words"))).alias("m"), *([_hashes(F.transform("words", F.lower)).alias("w")] if any(f != TEMPLATE for f, _ in forms) else []))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")

    def of(form: int, size: int) -> Column:
        source = "m" if form == TEMPLATE else "w"
        last = F.size(source) - size
        fits = (last == 0) if form == WHOLE else (last >= 0)
        return F.when(fits, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("at"), _window(F.col(source), i, size, form).alias("hash")))).otherwise(none)

    every = [of(form, size) for form, size in forms]
    return hashed.select("doc_id", "t", F.inline(F.concat(*every) if len(every) > 1 else every[0] if every else none))


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, t, item_id, item_t, item_windows, covered_windows and changed_slots of every text that holds an item."""
    windows = benchmark_windows(benchmark)
    # kinds and lengths: two dozen at most
    forms = sorted((r["form"], r["size"]) for r in windows.select("form", "size").distinct().collect())
    docs = docs.select("doc_id", "text").where("text is not null")
    hashes = F.broadcast(windows) if is_small(windows, BENCHMARK_ROWS) else windows
    matches = _spans(docs, forms).join(hashes, "hash").select("doc_id", "t", "item_id", "item_t", "size", "item_windows", "item_at", (F.col("at") - F.col("item_at")).alias("shift"))
    # a window's place at its shift; a document that repeats a passage has several shifts
    pair = ["doc_id", "t", "item_id", "item_t"]
    at_shift = held(matches.groupBy(*pair, "shift", "size", "item_windows").agg(F.collect_set("item_at").alias("places")))
    enough = at_shift.groupBy(*pair).agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("covered"), F.max("item_windows").alias("of")).where("2 * covered >= of").select(*[F.col(c).alias(f"_{c}") for c in pair])
    same = lambda left, right, names: [left[c].eqNullSafe(right[f"_{c}"]) for c in names]
    likely = at_shift.join(enough, same(at_shift, enough, pair), "left_semi")

    # the words behind the placeholders
    wanted = bounded_broadcast(held(likely.select(F.col("doc_id").alias("_doc_id"), F.col("t").alias("_t")).distinct()))
    keyed = docs.withColumn("t", F.xxhash64("text"))
    texts = keyed.join(wanted, same(keyed, wanted, ["doc_id", "t"]), "left_semi").dropDuplicates(["doc_id", "t"])
    texts = texts.select(F.col("doc_id").alias("_doc_id"), F.col("t").alias("_t"), _words(F.col("text")).alias("doc_words")).withColumn("marks", _marks(F.col("doc_words")))
    items = benchmark.select("item_id", "text").where("text is not null").distinct().select(F.col("item_id").alias("_item_id"), F.xxhash64("text").alias("_item_t"), _words(F.col("text")).alias("item_words"))
    both = likely.join(texts, same(likely, texts, ["doc_id", "t"])).join(items, same(likely, items, ["item_id", "item_t"]))
    spots = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1))))
    spots = F.filter(spots, lambda p: F.get("marks", p + F.col("shift")).isin(*MARKS))
    slots = F.transform(spots, lambda p: F.struct(p.alias("at"), F.struct(F.get("marks", p + F.col("shift")).alias("kind"), _bare(F.get("item_words", p)).alias("item")).alias("source"), _bare(F.get("doc_words", p + F.col("shift"))).alias("doc")))
    both = both.withColumn("slots", slots)
    inside = lambda p: F.filter("slots", lambda s: (s["at"] >= p) & (s["at"] < p + F.col("size")))
    values = lambda own: F.array_distinct(F.transform(own, lambda s: F.struct(s["source"].alias("source"), s["doc"].alias("doc"))))
    sources = lambda own: F.array_distinct(F.transform(own, lambda s: s["source"]))
    both = both.withColumn("steady", F.filter("places", lambda p: F.size(values(inside(p))) == F.size(sources(inside(p))))).where(F.size("steady") > 0)
    within = F.filter("slots", lambda s: F.exists("steady", lambda p: (s["at"] >= p) & (s["at"] < p + F.col("size"))))
    changed = F.size(F.filter(values(within), lambda s: s["source"]["item"] != s["doc"]))
    held_by = both.groupBy(*pair).agg(F.size(F.array_distinct(F.flatten(F.collect_set("steady")))).alias("covered_windows"), F.max("item_windows").alias("item_windows"), F.min(changed).alias("changed_slots"))
    return held_by.where("2 * covered_windows >= item_windows")


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_windows, covered_windows and changed_slots of every document that holds an item."""
    # rows that repeat a doc_id with other texts: the fullest match counts
    best = F.max(F.struct("covered_windows", "item_windows", -F.col("changed_slots"))).alias("best")
    return _pairs(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.item_windows").cast("long").alias("item_windows"), F.col("best.covered_windows").cast("long").alias("covered_windows"), (-F.col("best.col3")).cast("long").alias("changed_slots"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, columns as they are. Of rows that share a doc_id (or have none) only those go whose own text holds one."""
    gone = held(_pairs(docs, benchmark).select(F.col("doc_id").alias("gone"), F.col("t").alias("gone_t")).distinct())
    gone = bounded_broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_t"]), "left_anti")

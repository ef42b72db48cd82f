"""Benchmark decontamination by spaced seeds.

A mask lays a few marked places over a short stretch of tokens; the tokens between the marks do
not matter, so a replaced word spoils only the seeds that mark it. Seeds of all stretches of the
benchmark are joined with those of all stretches of the documents. A hit fixes an item and a
shift; around it item and document are laid side by side and compared word by word: where `window`
words in a row (or a whole shorter item) agree in `percent` of the places, the item is in the document.

Most stretches are dropped before the join by two bit tables of fixed size, one of the words and
one of the seeds of the benchmark. A larger benchmark only makes them less selective.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Null and empty texts have no words. Items with fewer
words than the longest mask are too short to tell and match nothing. Rows of equal id and text
are found together; a document without an id is reported without one. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.components import kept

#: Whichever three of fifteen words are replaced, one of these masks still fits (a test tries all 455 ways).
MASKS = ("110100011", "1010111", "111100001")
#: Items of 9 to 14 words have this one too: with it a fifth of any of them may be replaced (a test tries all ways).
SHORT_MASK = "1100111"
WINDOW, PERCENT = 15, 80
#: Bits of the tables, as a power of two.
TABLE_BITS = 17
WHITE = r"[\x20\x09-\x0D]+"
DOC = ("d1", "d2")


def hashed_words(column: str) -> Column:
    """The words of a text as 64-bit hashes."""
    low = F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(low, WHITE), lambda word: word != ""), lambda word: F.xxhash64(word))


def _offsets(mask: str) -> list[int]:
    return [place for place, mark in enumerate(mask) if mark == "1"]


def _seed(number: int, mask: str, words: Column, start: Column) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, start + o) for o in _offsets(mask)])


def _starts(words: Column, mask: str) -> Column:
    n = F.size(words) - len(mask)
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _table(hashes: DataFrame) -> Column:
    """The bits of a column of hashes as a constant array of 64-bit words; its size is fixed."""
    slot = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    rows = hashes.select(slot.alias("slot")).distinct()
    rows = rows.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    found = dict(rows.collect())
    text = ",".join(str(found.get(word, 0)) for word in range(1 << TABLE_BITS - 6))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def _in_table(table: Column, value: Column) -> Column:
    slot = F.shiftrightunsigned(value, 64 - TABLE_BITS)
    bits = F.get(table, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", bits, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """mask, h, item_id, at: every seed of every item; items has item_id and words. The short mask has the number after the others."""
    longest = max(map(len, masks))
    long_enough = items.filter(F.size("words") >= longest)

    def of(number: int, mask: str) -> Column:
        return F.transform(_starts(F.col("words"), mask), lambda at: F.struct(F.lit(number).alias("mask"), _seed(number, mask, F.col("words"), at).alias("h"), at.alias("at")))

    short = F.filter(of(len(masks), SHORT_MASK), lambda _: F.size("words") < WINDOW)
    every = F.concat(*[of(number, mask) for number, mask in enumerate(masks)], short)
    return long_enough.select("item_id", F.explode(every).alias("s")).select("s.mask", "s.h", "item_id", "s.at")


def hits(docs: DataFrame, words_table: Column, seeds_table: Column, masks: tuple[str, ...]) -> DataFrame:
    """d1, d2, mask, h, at: seeds of documents that may be seeds of the benchmark. docs has d1, d2 and words.

    A word the benchmark lacks is null, so that a stretch is left as soon as a marked word is null.
    """
    known = docs.select(*DOC, F.transform("words", lambda h: F.when(_in_table(words_table, h), h)).alias("words"))
    words = F.col("words")

    def met(number: int, mask: str) -> Column:
        offsets = _offsets(mask)

        def may(at: Column) -> Column:
            all_known = F.get(words, at).isNotNull()
            for o in offsets[1:]:
                all_known = all_known & F.get(words, at + o).isNotNull()
            return all_known & _in_table(seeds_table, _seed(number, mask, words, at))

        found = F.filter(_starts(words, mask), may)
        return F.transform(found, lambda at: F.struct(F.lit(number).alias("mask"), _seed(number, mask, words, at).alias("h"), at.alias("at")))

    every = F.concat(*[met(n, m) for n, m in enumerate(masks)])
    return known.select(*DOC, F.explode(every).alias("s")).select(*DOC, "s.mask", "s.h", "s.at")


def overlaps(docs: DataFrame, items: DataFrame, column: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """d1, d2, doc_id, item_id, n_equal, n_item: items found in documents, with the most words that agree at one shift."""
    marked = marked_docs(docs, column)
    tests = kept(items.select("item_id", hashed_words("text").alias("words")))
    test_seeds = kept(seeds(tests, masks))
    words_table = _table(tests.select(F.explode("words").alias("h")))
    seeds_table = _table(test_seeds.select("h"))
    texts = marked.select(*DOC, hashed_words(column).alias("words"))
    # Documents are searched for the short mask only if an item has seeds of it.
    searched = masks if test_seeds.filter(F.col("mask") == len(masks)).isEmpty() else (*masks, SHORT_MASK)
    found = kept(hits(texts, words_table, seeds_table, searched))
    shifts = found.withColumnRenamed("at", "here").join(test_seeds, ["mask", "h"]).select(*DOC, "item_id", (F.col("here") - F.col("at")).alias("shift")).distinct()
    tests = tests.withColumnRenamed("words", "item_words").filter(F.size("item_words") > 0)
    # Only documents with a hit are read again.
    asked = kept(shifts.join(tests, "item_id").groupBy(*DOC).agg(F.collect_list(F.struct("item_id", "shift", "item_words")).alias("asked")))
    again = marked.select(*DOC, "doc_id", column).dropDuplicates(DOC).join(asked, list(DOC))
    again = again.select(*DOC, "doc_id", hashed_words(column).alias("words"), F.explode("asked").alias("a"))
    equal = F.transform("a.item_words", lambda word, place: F.coalesce((F.get("words", place + F.col("a.shift")) == word), F.lit(False)).cast("int"))
    size = F.size("item_words")
    width = F.least(F.lit(window), size)
    agree = F.exists(
        F.sequence(F.lit(0), size - width),
        lambda start: 100 * F.aggregate(F.slice("equal", start + 1, width), F.lit(0), lambda total, one: total + one) >= percent * width,
    )
    # A shift before the document's start is a place that does not exist.
    laid = again.select(*DOC, "doc_id", F.col("a.item_id").alias("item_id"), F.col("a.item_words").alias("item_words"), equal.alias("equal"))
    laid = laid.filter(agree).withColumn("n_equal", F.aggregate("equal", F.lit(0), lambda total, one: total + one))
    return laid.groupBy(*DOC, "doc_id", "item_id").agg(F.max("n_equal").cast("bigint").alias("n_equal"), F.first(F.size("item_words")).cast("bigint").alias("n_item"))


def marked_docs(docs: DataFrame, column: str) -> DataFrame:
    """docs with d1 and d2, 128 bits that stand for the row's id and text."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col(column))
    return docs.withColumns({"d1": F.xxhash64(*parts), "d2": F.xxhash64(F.lit(1), *parts)})


def clean(docs: DataFrame, items: DataFrame, column: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """docs without those that hold a benchmark item."""
    found = kept(overlaps(docs, items, column, masks, window, percent).select(*DOC).distinct())
    return marked_docs(docs, column).join(found, list(DOC), "left_anti").select(*docs.columns)

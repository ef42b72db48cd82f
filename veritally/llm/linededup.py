"""Repeated runs of lines, found by prefix doubling over line ids; later copies are deleted.

Lines with a word get an id from their bytes; blank lines do not count. Prefix doubling names
the runs of 1, 2, 4, ... lines that begin at each line from the names of their halves, and after each
doubling keeps only names that occur twice: a name then stands for an interval of the suffixes
that have so many lines in common, and a run of any other length for two overlapping names.
Doubling ends at the longest run that can hold `min_words` words with no line to spare, because
every longer repeated run is a union of such runs.

A line goes if it lies in a run of lines of one document, of `min_words` words or more, that
also begins at an earlier place: in a document of smaller id (ids of null last, then by a hash
of the text), or further up in the same one. The first copy of every run stays.

Rows of equal id and text count as one document and get the same result. A null text stays
null, an empty one empty; both have no lines to lose. Only DataFrame operations are used. A line that very many
documents share meets sums made in each task and joins between written tables, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.components import kept

MIN_WORDS = 25
#: White characters as words know them.
WHITE = r"[\x20\x09-\x0D]+"
DOC = ("d1", "d2")


def _marked(docs: DataFrame, column: str) -> DataFrame:
    """docs with d1 and d2, 128 bits that stand for the row's id and text."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col(column))
    return docs.withColumns({"d1": F.xxhash64(*parts), "d2": F.xxhash64(F.lit(1), *parts)})


def lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per line with a word: d1, d2, doc_id, line (its place), i (its number), name (x, y), w (words)."""
    every = F.transform(F.split(F.col(column), "\n", -1), lambda value, place: F.struct(place.alias("line"), value.alias("value")))
    real = F.filter(every, lambda each: each["value"].rlike(r"[^\x20\x09-\x0D]"))
    return (
        _marked(docs, column)
        .select(*DOC, "doc_id", real.alias("real"))
        .dropDuplicates(DOC)
        .select(*DOC, "doc_id", F.posexplode("real").alias("i", "each"))
        .select(
            *DOC,
            "doc_id",
            F.col("each.line").alias("line"),
            "i",
            F.xxhash64("each.value").alias("x"),
            F.xxhash64(F.lit(1), "each.value").alias("y"),
            # White characters before the first word give an empty part, and so do those after the last.
            F.size(F.filter(F.split("each.value", WHITE), lambda part: part != "")).alias("w"),
        )
    )


def _repeated(named: DataFrame) -> DataFrame:
    """Rows whose name (x, y) occurs more than once."""
    again = kept(named.groupBy("x", "y").agg(F.count("*").alias("c")).filter("c > 1").select("x", "y"))
    return named.join(again, ["x", "y"])


def doubled(level: DataFrame, length: int) -> DataFrame:
    """Names of runs of 2 * length lines from those of length lines, only what repeats."""
    ahead = level.select(*DOC, (F.col("i") - length).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = level.join(ahead, [*DOC, "i"])
    return _repeated(both.select(*DOC, "i", *_joined(F.lit(2 * length))))


def _joined(length):
    """The name of a run of so many lines from the names of its first and last part."""
    return F.xxhash64(length, "x", "y", "x2", "y2").alias("x"), F.xxhash64(length, "y", "x2", "y2", "x").alias("y")


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Runs with min_words words that lose them without their first or without their last line: d1, d2, doc_id, i (start), m (lines)."""
    doc = Window.partitionBy(*DOC)
    upto = doc.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("after", F.sum("w").over(upto)).withColumn("before", F.col("after") - F.col("w"))
    # Words before a line grow with every line, so a range of words is a range of lines.
    beyond = F.min("i").over(doc.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing))
    within = F.max("i").over(doc.orderBy("after").rangeBetween(Window.unboundedPreceding, -min_words))
    rows = rows.select(*DOC, "doc_id", "i", "before", "after", beyond.alias("stop"), (F.coalesce(within, F.lit(-1)) + 1).alias("start"))
    rows = rows.withColumn("last", F.max("i").over(doc)).withColumn("total", F.max("after").over(doc))
    first = rows.filter(F.col("total") - F.col("before") >= min_words).select(
        *DOC, "doc_id", "i", (F.coalesce("stop", F.col("last") + 1) - F.col("i")).alias("m")
    )
    last = rows.filter(F.col("after") >= min_words).select(*DOC, "doc_id", F.col("start").alias("i"), (F.col("i") - F.col("start") + 1).alias("m"))
    return first.unionByName(last).distinct()


def _place():
    """Order of documents and lines: null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2", "i")


def later_copies(docs: DataFrame, column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that also begin at an earlier place: d1, d2, i, m, and the earlier document's id (first_doc)."""
    rows = kept(lines(docs, column))
    level = kept(_repeated(rows.select(*DOC, "i", "x", "y")))
    # Only windows that begin and end with a repeated line can be repeated.
    runs = kept(windows(rows, min_words).join(level.select(*DOC, "i"), [*DOC, "i"]))
    named, length = None, 1
    while True:
        here = runs.filter((F.col("m") >= length) & (F.col("m") < 2 * length))
        tail = level.select(*DOC, F.col("i").alias("tail"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        parts = here.join(level, [*DOC, "i"]).withColumn("tail", F.col("i") + F.col("m") - length).join(tail, [*DOC, "tail"])
        parts = parts.select(*DOC, "doc_id", "i", "m", *_joined(F.col("m")))
        named = parts if named is None else named.unionByName(parts)
        if 2 * length > min_words:
            break
        level, length = kept(doubled(level, length)), 2 * length
    named = kept(named)
    firsts = kept(named.groupBy("x", "y").agg(F.min(_place()).alias("first"), F.count("*").alias("c")).filter("c > 1"))
    found = named.join(firsts.select("x", "y", "first"), ["x", "y"]).filter(_place() > F.col("first"))
    return found.select(*DOC, "i", "m", F.col("first.doc_id").alias("first_doc")).join(
        rows.select(*DOC, F.col("i").alias("n"), "line").groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("places")), list(DOC)
    )


def dedup(docs: DataFrame, column: str = "text", min_words: int = MIN_WORDS, removed: str = "removed_lines") -> DataFrame:
    """docs without later copies of repeated runs; `removed` counts the lines that went."""
    names = [c for c in docs.columns if c != removed]
    gone = (
        later_copies(docs, column, min_words)
        .select(*DOC, F.explode(F.slice("places", F.col("i") + 1, F.col("m"))).alias("place"))
        .groupBy(*DOC)
        .agg(F.collect_set("place.line").alias("gone"))
    )
    marked = _marked(docs.select(*names), column).join(kept(gone), list(DOC), "left")
    parts = F.split(F.col(column), "\n", -1)
    left = F.filter(parts, lambda value, place: ~F.array_contains(F.col("gone"), place))
    return marked.select(
        *[F.when(F.col("gone").isNull(), F.col(column)).otherwise(F.array_join(left, "\n")).alias(column) if c == column else F.col(c) for c in names],
        F.coalesce(F.size("gone"), F.lit(0)).alias(removed),
    )

"""Line dedup: repeated windows of three lines, found over all documents.

Native. Windows are pre-aggregated to their first occurrence before any shuffle by
key, and a window that half of the documents share is only ever reduced to a minimum
or joined by an exchange that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut, fresh, let

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _blank(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) == 0


def line_windows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``d, s, p, h1, h2``: a row for each three-line window that has a word.

    d, s tell the document (its id, and a hash of its text, for ids that occur twice);
    p is the window's first line from 0, h1 and h2 together are a hash of 128 bits.
    """

    def hashes(x: Column) -> Column:
        each = F.transform(
            F.slice(x, 1, F.size(x) - (WINDOW - 1)),
            lambda a, i: let(
                F.struct(F.get(x, i + 1).alias("b"), F.get(x, i + 2).alias("c")),
                lambda n: F.when(
                    ~(_blank(a) & _blank(n["b"]) & _blank(n["c"])),
                    F.struct(i.alias("p"), F.xxhash64(a, n["b"], n["c"]).alias("h1"), F.xxhash64(F.lit(7), n["c"], F.length(a), n["b"], a).alias("h2")),
                ),
            ),
        )
        return F.filter(each, lambda w: w.isNotNull())

    found = F.when(F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)) >= WINDOW, let(_lines(F.col(text)), hashes))
    rows = docs.select(F.col(id).alias("d"), F.xxhash64(F.col(text)).alias("s"), F.explode(found).alias("w"))
    return rows.select("d", "s", "w.p", "w.h1", "w.h2")


def repeated_starts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``d, s, starts``: for each document, the first lines of windows that have occurred before.

    Occurrences are ordered by document id (null first), then text hash, then line.
    """
    windows = line_windows(docs, id, text).distinct()
    place = F.struct("d", "s", "p")
    firsts = cut(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(firsts.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return cut(later.groupBy("d", "s").agg(F.sort_array(F.collect_list("p")).alias("starts")))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` without the lines that a later occurrence of a repeated window covers.

    A window is three consecutive lines (split at ``\\n``, compared exactly) of which one
    has a word. Its first occurrence over all documents stays whole unless another
    window's later occurrence covers some of its lines; overlapping later occurrences
    merge. Columns and their order stay; ``removed`` names a column for the number of
    lines taken out (replacing one of that name). Null texts stay null; texts of under
    three lines stay. Rows that repeat an id with the same text count as one document
    and get the same result. Empty table: empty.
    """
    starts = repeated_starts(docs, id, text).select(F.col("d").alias("_d"), F.col("s").alias("_s"), "starts")
    d, s, at = (fresh(docs, x) for x in ("_line_d", "_line_s", "_line_at"))
    starts = starts.toDF(d, s, at)
    joined = docs.join(starts.hint("merge"), docs[id].eqNullSafe(starts[d]) & (F.xxhash64(docs[text]) == starts[s]), "left")

    def clean(x: Column) -> Column:
        gone = F.flatten(F.transform(F.col(at), lambda p: F.sequence(p, p + (WINDOW - 1))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
        return F.transform(kept, lambda k: F.get(x, k))

    left, n = fresh(joined, "_line_left"), fresh(joined, "_line_n")
    joined = joined.withColumn(left, F.when(F.col(at).isNotNull(), let(_lines(F.col(text)), clean)))
    gone = F.when(F.col(at).isNotNull(), F.size(_lines(F.col(text))) - F.size(left)).otherwise(0).cast("long")
    new = F.when(F.col(at).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))
    columns = [new.alias(c) if c == text else F.col(c) for c in docs.columns if c != removed]
    return joined.withColumn(n, gone).select(*columns, *([F.col(n).alias(removed)] if removed else []))

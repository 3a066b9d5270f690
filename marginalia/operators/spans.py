"""Labels to entity spans and between label schemes. Four decoders that differ on odd input; ends are inclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import strip_bio
from marginalia.operators.segments import SEGMENT, segmented
from marginalia.operators.tokens import DOC, by_doc, dealt, so_far


def _runs(rows: DataFrame, opens: Column, keep: Column, label: Column, keys: tuple[str, ...] = DOC, run: Column | None = None) -> DataFrame:
    """Rows from each opening on, as spans; rows where ``keep`` is false belong to none. ``run``: what tells the openings apart, if that is known."""
    rows = rows.withColumns({"_type": label, "_opens": opens} if run is None else {"_type": label, "_run": run}).where(keep)
    if run is None:  # few tokens are kept, and only those that are open a run
        rows = rows.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(so_far(keys)))
    item = F.struct("idx", "text")
    spans = rows.groupBy(*keys, "_run").agg(F.min_by("_type", "idx").alias("type"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.sort_array(F.collect_list(item)).alias("t"))
    return spans.select(*keys, "type", "start_idx", "end_idx", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), F.transform("t", lambda x: x["idx"]).alias("token_indices"))


def _long_runs(rows: DataFrame, run: Column, label: Column, opens: Callable[[Column, Column], Column], keys: tuple[str, ...]) -> DataFrame:
    """Spans of rows in segments (of ``segmented``); ``run``: the place where a row's run opened in its segment, -1 for none, null if that is up to the segments before.

    Each segment makes pieces, in one pass. Its first one goes on with the run of the piece
    before, if that is one, unless ``opens`` says so of the labels before and at its start
    (null: no label before). Only pieces are put in order by sequence.
    """
    within = Window.partitionBy(SEGMENT).orderBy("idx")
    rows = rows.withColumns({"_run": run, "_type": label, "_ends": F.lead("idx").over(within).isNull()})
    kept = F.coalesce(F.col("_run"), F.lit(0)) >= 0
    pieces = rows.where(kept | F.col("_ends")).groupBy(SEGMENT, "_run").agg(
        F.min_by("_type", "idx").alias("type"), F.min_by("label", "idx").alias("head"), F.max_by("label", "idx").alias("tail"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"),
        F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("t"),
    )
    text, places = F.array_join(F.transform("t", lambda x: x["text"]), " "), F.transform("t", lambda x: x["idx"])
    pieces = pieces.select(*[F.col(f"{SEGMENT}.{k}").alias(k) for k in keys], "_run", "type", "head", "tail", "start_idx", "end_idx", F.when(kept, text).alias("text"), F.when(kept, places).alias("places"))
    # all pieces of a sequence are put in order in one task, so sequences are dealt in many parts, as texts are
    pieces = dealt(pieces, *keys)
    order = Window.partitionBy(*keys).orderBy("end_idx")
    pieces = pieces.withColumn("_before", F.lag("tail").over(order))
    pieces = pieces.withColumn("_run", F.coalesce("_run", F.when(opens(F.col("_before"), F.col("head")), F.col("start_idx"))))
    pieces = pieces.withColumn("_run", F.last("_run", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_run >= 0")
    parts = F.array_sort(F.collect_list(F.struct("start_idx", "text", "places")))
    whole = pieces.groupBy(*keys, "_run").agg(F.min_by("type", "start_idx").alias("type"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), parts.alias("parts"))
    of = lambda c: F.transform("parts", lambda p: p[c])
    return whole.select(*keys, "type", "start_idx", "end_idx", F.array_join(of("text"), " ").alias("text"), F.flatten(of("places")).alias("token_indices"))


def _long_runs_by_label(rows: DataFrame, opens: Callable[[Column, Column], Column], keep: Column, label: Column, keys: tuple[str, ...], segment: int) -> DataFrame:
    """``_runs`` in segments; ``opens`` looks at the label before (null for none) and the label."""
    within = Window.partitionBy(SEGMENT).orderBy("idx")
    rows = segmented(rows, segment, keys).withColumns({"_before": F.lag("label").over(within), "_first": F.lag("idx").over(within).isNull()})
    opening = F.when(~F.col("_first") & opens(F.col("_before"), F.col("label")), F.col("idx"))
    run = F.last(opening, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _long_runs(rows, F.when(keep, run).otherwise(-1), label, opens, keys)


def io_spans(rows: DataFrame, keys: tuple[str, ...] = DOC, segment: int | None = None) -> DataFrame:
    """Maximal runs of one label that isn't O; neighbours of one type merge. ``keys`` tell sequences apart; ``segment``: tokens that are dealt together, none for whole sequences."""
    io = strip_bio(F.col("label"))
    if segment:
        return _long_runs_by_label(rows, lambda a, b: ~F.coalesce(strip_bio(a) == strip_bio(b), F.lit(False)), io != "O", io, keys, segment)
    opens = ~F.coalesce(F.lag(io).over(by_doc(keys)) == io, F.lit(False))
    return _runs(rows.withColumn("_opens", opens), F.col("_opens"), io != "O", io, keys)


def bio_spans(rows: DataFrame, words_only: bool = True, segment: int | None = None, keys: tuple[str, ...] = DOC) -> DataFrame:
    """B opens, I goes on whatever its type, O closes; an I without a span is dropped. Marks are looked through with ``words_only``. ``keys`` and ``segment`` as for ``io_spans``."""
    rows = rows.where("is_word") if words_only else rows
    closes = F.startswith("label", F.lit("B-")) | (F.col("label") == "O")
    if segment:
        up_to = Window.partitionBy(SEGMENT).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        opened = F.when(closes, F.when(F.col("label") == "O", -1).otherwise(F.col("idx")))
        run = F.last(opened, ignorenulls=True).over(up_to)
        return _long_runs(segmented(rows, segment, keys), run, strip_bio(F.col("label")), lambda _, b: F.lit(False), keys)
    rows = rows.withColumn("_close", F.last(F.when(closes, F.struct("idx", "label")), ignorenulls=True).over(so_far(keys)))
    return _runs(rows.where(F.startswith("_close.label", F.lit("B-"))), closes, F.lit(True), strip_bio(F.col("label")), keys, F.col("_close.idx"))


def sentence_spans(rows: DataFrame, segment: int | None = None) -> DataFrame:
    """As ``bio_spans`` over all rows, and a sentence's end closes too; ``rows`` have ``sent_id``."""
    return bio_spans(rows.select("doc_id", "sent_id", "idx", "text", "label"), words_only=False, segment=segment, keys=("doc_id", "sent_id"))


def chunk_spans(rows: DataFrame, keys: tuple[str, ...] = DOC, segment: int | None = None) -> DataFrame:
    """The lenient reading for metrics: an I after O or after another type opens a span. ``keys`` and ``segment`` as for ``io_spans``."""
    io = strip_bio(F.col("label"))
    if segment:
        begins = lambda a, b: (b != "O") & (F.startswith(b, F.lit("B-")) | ~F.coalesce(strip_bio(a) == strip_bio(b), F.lit(False)))
        return _long_runs_by_label(rows, begins, io != "O", io, keys, segment)
    opens = (io != "O") & (F.startswith("label", F.lit("B-")) | ~F.coalesce(F.lag(io).over(by_doc(keys)) == io, F.lit(False)))
    return _runs(rows.withColumn("_opens", opens), F.col("_opens"), io != "O", io, keys)


def spans_of_ways(rows: DataFrame, ways: list[str], merge: bool = False) -> DataFrame:
    """``chunk_spans`` (``merge``: ``io_spans``) of each of the label columns ``ways``, with a column ``way``.

    What a label stands after is looked up for all ways in one pass; then only the few
    tokens that are in a span fall apart by way.
    """
    rows = rows.withColumns({f"_before{i}": F.lag(w).over(by_doc()) for i, w in enumerate(ways)})
    named = rows.where(F.greatest(*[F.coalesce(F.col(w) != "O", F.lit(False)) for w in ways]))
    sides = F.array(*[F.struct(F.lit(w).alias("way"), F.col(w).alias("label"), F.col(f"_before{i}").alias("before")) for i, w in enumerate(ways)])
    rows = named.select("doc_id", "idx", "text", F.explode(sides).alias("w")).select("doc_id", "idx", "text", "w.*")
    io, opens = strip_bio(F.col("label")), ~F.coalesce(strip_bio(F.col("before")) == strip_bio(F.col("label")), F.lit(False))
    return _runs(rows, opens if merge else opens | F.startswith("label", F.lit("B-")), io != "O", io, (*DOC, "way"))


def io_to_bio(rows: DataFrame, io: str = "io") -> DataFrame:
    """``label`` with B where the type differs from the label before, in order; only O comes between."""
    before = F.lag(io).over(by_doc())
    return rows.withColumn("label", F.when(F.col(io) == "O", "O").otherwise(F.concat(F.when(F.coalesce(before == F.col(io), F.lit(False)), "I-").otherwise("B-"), F.col(io))))


def conll_lines(rows: DataFrame) -> DataFrame:
    """``doc_id, idx, line``: token and label, O for marks, and an empty line's break after a stop."""
    label = F.when(F.col("is_word"), F.col("label")).otherwise("O")
    stop = ~F.col("is_word") & F.col("text").isin(".", "!", "?")
    return rows.select("doc_id", "idx", F.concat(F.col("text"), F.lit(" "), label, F.when(stop, "\n").otherwise("")).alias("line"))


def conll_documents(rows: DataFrame) -> DataFrame:
    """``doc_id, value``: each document's lines as one text ending in a line break."""
    lines = conll_lines(rows).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return lines.select("doc_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))

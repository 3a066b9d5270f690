"""The whole way from documents to labelled tokens and spans, as one lazy plan.

Signals are columns beside the tokens, not tables to join back: names come by a lookup
on the word, capitals by windows on the exchange that voting uses too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import signals as sg
from marginalia.operators.gazetteer import once
from marginalia.operators.segments import SEGMENT
from marginalia.operators.tokens import having, tokenize
from marginalia.operators.voting import labels_of_ways, vote


def annotate(docs: DataFrame, lex: sg.Lexicons, entities: DataFrame | None = None, places: DataFrame | None = None, persons: DataFrame | None = None, fuzzy: bool = True, capitals: bool = True, id: str = "doc_id", text: str = "text", segment: int | None = None) -> DataFrame:
    """Voted labels of every token. ``entities`` are found by whatever model the user runs; without them, or without name lists, those signals are silent.

    With ``segment``, documents are dealt out in segments of so many tokens, which the rows name.
    """
    tokens = tokenize(docs, id, text, keyed=True, segment=segment, around=bool(segment))
    rows, names = tokens, ["doc_id", "idx", "text", "is_word", *([SEGMENT] if segment else [])]
    found = {"s1": F.lit(None).cast("string"), "s2": F.lit(None).cast("string"), "s3": F.lit(None).cast("string")}
    if entities is not None:
        rows = _claimed(rows, docs, entities, id, text, "s1")
        found["s1"] = F.col("s1")
    if places is not None and persons is not None:
        rows = sg.mark_names(rows, places, persons, lex, fuzzy, tokens).withColumn("s2", F.col("label"))
        found["s2"] = F.col("s2")
    if capitals:
        rows = sg.mark_capitals(rows, lex, segment).withColumn("s3", F.col("label"))
        found["s3"] = F.col("s3")
    return vote(rows.select(*names, *[c.alias(n) for n, c in found.items()]), lex, segment=segment)


def _claimed(rows: DataFrame, docs: DataFrame, entities: DataFrame, id: str, text: str, name: str) -> DataFrame:
    """``rows`` with the labels of entities, for which only texts that have any fall into tokens again."""
    entities = once(entities)
    return sg.with_claims(rows, sg.project_entities(tokenize(having(docs, entities, id), id, text, keyed=True), entities), name)


#: What tells the sequences of ``annotate_ways`` apart.
WAYS = ("doc_id", "way")


@dataclass(frozen=True)
class Way:
    """How one annotation of several looks names up: the list columns of the name table that are its places and its persons (none: that signal is silent), and whether capitals, and entities if there are any, count."""

    places: str | None = None
    persons: str | None = None
    capitals: bool = True
    entities: bool = True


def annotate_ways(docs: DataFrame, lex: sg.Lexicons, table: DataFrame, ways: dict[str, Way], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Voted labels of every token in several ways (exact names of a ``gazetteer.name_table``, capitals), with a column ``way``.

    Tokens, names and capitals are worked out once; only the vote runs for each way.
    """
    rows, sides = _signalled(docs, lex, table, ways, id, text)
    none = F.lit(None).cast("string")
    sides = [F.struct(F.lit(n).alias("way"), s2.alias("s2"), s3.alias("s3")) for n, (s2, s3) in sides.items()]
    rows = rows.select("doc_id", "idx", "text", "is_word", F.explode(F.array(*sides)).alias("w"))
    return vote(rows.select("doc_id", "w.way", "idx", "text", "is_word", none.alias("s1"), F.col("w.s2").alias("s2"), F.col("w.s3").alias("s3")), lex, WAYS)


def annotate_beside(docs: DataFrame, lex: sg.Lexicons, table: DataFrame | dict[str, DataFrame], ways: dict[str, Way], id: str = "doc_id", text: str = "text", entities: DataFrame | None = None) -> DataFrame:
    """``doc_id, idx, text, is_word`` and a column for each of ``ways`` with its labels, as ``annotate_ways`` gives them. Tokens stay one row each and in one order, whatever the number of ways.

    With a dict of name lists for ``table``, similar names count too, and ``ways`` name
    its lists. Entities and lists are looked up once for all ways.
    """
    rows, sides = _signalled(docs, lex, table, ways, id, text, entities)
    return labels_of_ways(rows, lex, sides)


def _signalled(docs: DataFrame, lex: sg.Lexicons, table: DataFrame | dict[str, DataFrame], ways: dict[str, Way], id: str, text: str, entities: DataFrame | None = None) -> tuple[DataFrame, dict[str, tuple[Column, ...]]]:
    """Tokens with what any of the ways needs, and each way's signals on them: all three with ``entities``, else 2 and 3."""
    named = {n: w for n, w in ways.items() if w.places and w.persons}
    column = {n: f"_names_{i}" for i, n in enumerate(named)}
    rows = tokens = tokenize(docs, id, text, keyed=True)
    if entities is not None:
        rows = _claimed(rows, docs, entities, id, text, "_entity")
    if named:
        lists = {column[n]: (w.places, w.persons) for n, w in named.items()}
        rows = sg.similar_labels(rows, table, lists, lex, tokens) if isinstance(table, dict) else sg.exact_labels(rows, table, lists, lex)
    if any(w.capitals for w in ways.values()):
        rows = sg.mark_capitals(rows, lex)
    none = F.lit(None).cast("string")
    first = lambda w: () if entities is None else (F.col("_entity") if w.entities else none,)
    return rows, {n: (*first(w), F.col(column[n]) if n in named else none, F.col("label") if w.capitals else none) for n, w in ways.items()}


def document_summary(voted: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_words, n_person, n_location``: tokens, and spans by type (each begins with a B, so one aggregate does)."""
    begins = lambda kind: F.count_if(F.col("is_word") & (F.col("label") == f"B-{kind}"))
    return voted.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if("is_word").alias("n_words"), begins("Person").alias("n_person"), begins("Location").alias("n_location"))

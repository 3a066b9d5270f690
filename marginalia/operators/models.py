"""Entities from a user's model: texts in windows, the model loaded once for each task, places mapped back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import drop_asterisks, label_bucket, mapped_label
from marginalia.operators.corpus import merge_chunk_entities, text_windows

Model = Callable[[str], Iterable[Mapping]]
BatchModel = Callable[[Sequence[str]], Iterable[Iterable[Mapping]]]


def broadcast_model(spark: SparkSession, model: Model | BatchModel) -> Callable[[], Model | BatchModel]:
    """A ``load`` for ``run_model`` of a model that the driver has: it goes to each executor once, whatever the number of tasks."""
    sent = spark.sparkContext.broadcast(model)
    return lambda: sent.value


def _batches(texts: list[str], batch: int) -> Iterator[list[int]]:
    """Places of ``batch`` texts at a time, of like lengths, so that a model that pads pads little."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    return (order[at : at + batch] for at in range(0, len(order), batch))


def run_model(docs: DataFrame, load: Callable[[], Model | BatchModel], id: str = "doc_id", text: str = "text", batch: int | None = None) -> DataFrame:
    """``doc_id, ord, text, ner_label, mapped_label, bucket, score, start, end`` for each entity.

    ``load`` makes the model, which gives for a text mappings with entity_group, word,
    score, start and end. Asterisks are taken out first; long texts go through in
    overlapping windows, and what two windows find at one place counts once. Scores
    are rounded to four places; ``ord`` numbers a document's entities from its start.
    With ``batch`` the model takes a list of so many texts of like lengths and gives a
    list of their entities.
    """
    kind = docs.schema[id].dataType.simpleString()
    chunks = text_windows(docs.select(F.col(id).alias("doc_id"), drop_asterisks(F.col(text)).alias("text")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            texts = b["chunk"].tolist()
            found: list = [None] * len(texts)
            for some in _batches(texts, batch or 1):
                answers = model([texts[i] for i in some]) if batch else [model(texts[i]) for i in some]
                for i, entities in zip(some, answers, strict=True):
                    found[i] = entities
            rows = [
                (r.doc_id, r.chunk_no, e["word"], e["entity_group"], float(e["score"]), int(e["start"]) + r.chunk_start, int(e["end"]) + r.chunk_start)
                for r, entities in zip(b.itertuples(), found, strict=True) for e in entities
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "text", "ner_label", "score", "start", "end"])

    found = chunks.select("doc_id", "chunk_no", "chunk_start", "chunk").mapInPandas(work, f"doc_id {kind}, chunk_no int, text string, ner_label string, score double, start int, end int")
    once = merge_chunk_entities(found)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    label = mapped_label(F.col("ner_label"))
    return once.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "text", "ner_label", label.alias("mapped_label"), label_bucket(label).alias("bucket"), F.round("score", 4).alias("score"), "start", "end")

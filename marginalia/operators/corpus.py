"""Corpus work: filtering with accounts, splits, chunks, sections, adjudication, resuming."""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.arrays import let, running
from marginalia.operators.segments import SEGMENT, segmented

SECTION_MARK = "--- SIDBRYTNING ---"
DATE_HEAD = "datum:"


def classify(docs: DataFrame, lexicon: list[str], languages: tuple[str, ...] = ("svenska", "swedish"), text: str = "text", lang: str = "lang", least_words: int = 20, most: float = 0.5) -> DataFrame:
    """``docs`` with ``cleaned``, ``n_words`` and ``reason``: the first test that fails, or accepted."""
    raw, low = F.coalesce(F.col(text), F.lit("")), F.lower(F.coalesce(F.col(lang), F.lit("")))
    spoken = F.lit(False)
    for name in languages:
        spoken = spoken | F.contains(low, F.lit(name))
    rows = docs.withColumn("cleaned", tx.corpus_clean(raw)).withColumn("n_words", F.size(tx.split_words(F.col("cleaned"))))
    reason = F.when(tx.strip(raw) == "", "no_edition").when(~spoken, "wrong_language").when(F.col("n_words") < least_words, "too_short")
    return rows.withColumn("reason", reason.when(tx.lexicon_fraction(F.col("cleaned"), lexicon) > most, "too_much_lexicon").otherwise("accepted"))


def filter_statistics(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reason").agg(F.count("*").alias("n"))


def corpus_totals(classified: DataFrame) -> DataFrame:
    """``docs, words, chars`` of what was accepted."""
    ok = classified.where("reason = 'accepted'")
    return ok.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length("cleaned")), F.lit(0)).alias("chars"))


def remaining(docs: DataFrame, done: DataFrame, id: str = "doc_id", error: str | None = None) -> DataFrame:
    """What is still to do: rows whose id isn't among those done (without an error, where the column for it is given)."""
    done = done.where(F.col(error).isNull()) if error else done
    return docs.join(done.select(id).distinct(), id, "left_anti")


def split_by_hash(docs: DataFrame, id: str = "doc_id", shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """``doc_id, split``: ids in the order of a hash, cut at the floors of the shares.

    Ranks come from counts of a leading part of the hash, so no task sorts all ids.
    """
    rows = docs.select(F.col(id).alias("doc_id")).withColumn("h", F.md5(F.col("doc_id").cast("string"))).withColumn("part", F.substr("h", F.lit(1), F.lit(3)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # 4096 rows at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "doc_id"))
    ranked = rows.join(F.broadcast(sizes), "part").withColumn("rank", F.col("base") + rank)
    first, second = F.floor(F.col("total") * shares[0]), F.floor(F.col("total") * shares[1])
    return ranked.select("doc_id", F.when(F.col("rank") <= first, "train").when(F.col("rank") <= first + second, "val").otherwise("test").alias("split"))


def split_by_shuffle(names: list[str], seed: int = 42, shares: tuple[float, float] = (0.8, 0.1)) -> dict[str, list[str]]:
    """File names sorted, shuffled by a Mersenne Twister and cut at the floors of the shares."""
    names = sorted(names)
    random.Random(seed).shuffle(names)
    first, second = int(len(names) * shares[0]), int(len(names) * shares[1])
    return {"train": names[:first], "val": names[first : first + second], "test": names[first + second :]}


def sections(files: DataFrame, value: str = "value", mark: str = SECTION_MARK, head: str = r"(?i)SDHK\s+(\d+)") -> DataFrame:
    """``section_no, charter_id, section, body`` of whole files: sections that have a header, in order.

    The body is what follows the first line that begins with the date's head, or the
    whole section.
    """
    rows = files.select(*[c for c in files.columns if c != value], F.posexplode(F.split(F.col(value), rf"\Q{mark}\E")).alias("section_no", "section"))
    rows = rows.withColumn("charter_id", F.regexp_extract("section", head, 1)).where("charter_id <> ''")
    return rows.withColumn("body", body(F.col("section")))


def body(section: Column) -> Column:
    """After the first line whose stripped lower-case form begins with the date's head; the whole section if there is none."""
    lines = F.split(section, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.startswith(F.lower(tx.strip(x)), F.lit(DATE_HEAD))), True)
    return F.when(at > 0, F.array_join(F.slice(lines, at.cast("int") + 1, F.size(lines)), "\n")).otherwise(section)


def tagged_spans(rows: DataFrame, value: str = "body", tags: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``plain`` (the text without tags) and ``labels``: array of struct(type, start, end) over it, end exclusive.

    An opening tag sets the type, any closing tag ends it; tags don't nest. The text
    falls into tags and what stands between; what type a part has, and where it begins,
    are running values over the parts.
    """
    tags = tags or {"persname": "Person", "placename": "Location"}
    names, kinds = "|".join(tags), F.array(*[F.lit(v) for v in tags.values()])
    parts = F.regexp_extract_all(F.col(value), F.lit(r"<[^>]+>|[^<]+|<"), 0)
    opens = lambda p: F.coalesce(*[F.when(p.rlike(f"(?i)^<{t}(\\s[^>]*)?>$"), F.lit(k + 1)) for k, t in enumerate(tags)])
    # 0 ends a type, k begins the k-th, -1 is text
    code = lambda p: F.coalesce(opens(p), F.when(p.rlike(f"(?i)^</({names})\\s*>$"), 0), F.lit(-1))

    def of(item: Column) -> Column:
        state = running(F.transform(item, lambda x: x["code"]), lambda x, y: F.when(y >= 0, y).otherwise(x), -1)
        end = running(F.transform(item, lambda x: x["size"]), lambda x, y: x + y)
        every = F.zip_with(F.arrays_zip(state.alias("state"), end.alias("end")), item, lambda a, b: F.struct(a["state"].alias("state"), a["end"].alias("end"), b["code"].alias("code"), b["size"].alias("size")))
        typed = F.filter(every, lambda x: (x["code"] < 0) & (x["state"] > 0))
        return F.transform(typed, lambda x: F.struct(F.element_at(kinds, x["state"]).alias("type"), (x["end"] - x["size"]).alias("start"), x["end"].alias("end")))

    item = F.transform("_parts", lambda p: let(code(p), lambda c: F.struct(c.alias("code"), F.when(c < 0, F.length(p)).otherwise(0).alias("size"))))
    out = rows.withColumn("_parts", parts)
    return out.withColumn("plain", F.array_join(F.filter("_parts", lambda p: code(p) < 0), "")).withColumn("labels", let(item, of)).drop("_parts")


def tagged_tokens(rows: DataFrame, id: str, value: str = "body") -> DataFrame:
    """``doc_id, idx, text, is_word, io``: tokens of the cleaned text, each with the label of its first character.

    Tags are taken out and signs cleaned as elsewhere, so the tokens are those of the
    plain text; a token starts where it started before cleaning. Tokens and the ends and
    starts of labels go through one window, by place: a token has the last label that
    began and didn't end.
    """
    spans = tagged_spans(rows, value).select(F.col(id).alias("doc_id"), F.translate("plain", "º°", "  ").alias("plain"), "labels")

    def of(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.length(p)), lambda x, y: x + y)
        return F.zip_with(pieces, ends, lambda p, e: let(tx.token_of(p), lambda t: F.struct((e - F.length(t)).alias("at"), t.alias("text"), F.lit(None).cast("string").alias("type"))))

    found = let(tx.pieces(F.col("plain")), of)
    marks = F.flatten(F.transform("labels", lambda s: F.array(F.struct(s["start"].alias("at"), F.lit(None).cast("string").alias("text"), s["type"].alias("type")), F.struct(s["end"].alias("at"), F.lit(None).cast("string").alias("text"), F.lit("O").alias("type")))))
    events = spans.select("doc_id", F.explode(F.concat(marks, F.coalesce(found, F.array()))).alias("e")).select("doc_id", "e.*")
    # where a label ends and another begins, the beginning counts; marks come before the token at their place
    order = Window.partitionBy("doc_id").orderBy("at", F.col("text").isNotNull(), (F.col("type") != "O").cast("int"))
    labelled = events.withColumn("io", F.last("type", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("text is not null")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return labelled.select("doc_id", number.alias("idx"), "text", tx.is_word(F.col("text")).alias("is_word"), F.coalesce("io", F.lit("O")).alias("io"))


def missing_inputs(ids: DataFrame, raw: DataFrame, editions: DataFrame, id: str = "doc_id", edition: str = "text") -> DataFrame:
    """For every id of ``ids``: ``missing`` (no row in ``raw``) and ``without_edition`` (no text in ``editions``, or a blank one)."""
    rows = ids.select(id).distinct().join(raw.select(id, F.lit(True).alias("_raw")).distinct(), id, "left").join(editions.select(id, F.col(edition).alias("_e")), id, "left")
    return rows.select(id, F.col("_raw").isNull().alias("missing"), (F.coalesce(tx.strip(F.col("_e")), F.lit("")) == "").alias("without_edition"))


def evaluation_inputs(ids: DataFrame, raw: DataFrame, editions: DataFrame, id: str = "doc_id", summary: str = "summary", edition: str = "text") -> DataFrame:
    """``id, summary, edition`` for every id of ``ids``; fails where ``missing_inputs`` finds one missing."""
    fails = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col(id).cast("string"))).cast("string")
    rows = missing_inputs(ids, raw, editions, id, edition).join(raw.select(id, F.coalesce(F.col(summary), F.lit("")).alias(summary)), id, "left").join(editions.select(id, F.col(edition).alias("_e")), id, "left")
    text = F.when(F.col("missing"), fails("not among the raw documents")).when(F.col("without_edition"), fails("no edition text")).otherwise(F.col("_e"))
    return rows.select(id, summary, text.alias("edition"))


def adjudicate(owned: DataFrame, decisions: DataFrame, coders: int) -> DataFrame:
    """``item_id, coder, kind``: items that all ``coders`` hold go to the coder of ``decisions``, others to their owner.

    Fails if the decided items aren't just the shared ones, or an item would come out
    more than once.
    """
    held = owned.groupBy("item_id").agg(F.count_distinct("coder").alias("n"))
    shared = held.where(F.col("n") == coders).select("item_id")
    both = shared.withColumn("s", F.lit(1)).join(decisions.select("item_id", "coder"), "item_id", "full_outer")
    decided = both.select("item_id", F.when(F.col("s").isNotNull() & F.col("coder").isNotNull(), F.col("coder")).otherwise(F.raise_error(F.concat(F.lit("shared and decided items differ: "), F.col("item_id").cast("string"))).cast("string")).alias("coder"), F.lit("adjudicated").alias("kind"))
    unique = owned.select("item_id", "coder").distinct().join(shared, "item_id", "left_anti").withColumn("kind", F.lit("unique"))
    out = unique.unionByName(decided)
    times = F.count("*").over(Window.partitionBy("item_id"))
    return out.withColumn("times", times).select("item_id", F.when(F.col("times") == 1, F.col("coder")).otherwise(F.raise_error(F.concat(F.lit("item comes out more than once: "), F.col("item_id").cast("string"))).cast("string")).alias("coder"), "kind")


def manifest(adjudicated: DataFrame) -> DataFrame:
    """``coder, unique_items, adjudicated_items, total`` by coder, and with a null coder over all."""
    return adjudicated.rollup("coder").agg(F.count_if(F.col("kind") == "unique").alias("unique_items"), F.count_if(F.col("kind") == "adjudicated").alias("adjudicated_items"), F.count("*").alias("total"))


def _sizes(words: Column, budget: int) -> Column:
    """The sizes of array<struct<label, size>>, from 1 to one over the budget, below zero for an O."""
    size = lambda x: F.greatest(F.lit(1), F.least(F.coalesce(x["size"], F.lit(1)), F.lit(budget + 1))).cast("int")
    return F.transform(words, lambda x: F.when(x["label"] == "O", -size(x)).otherwise(size(x)))


def _cuts(sizes: np.ndarray, budget: int) -> np.ndarray:
    """For each word (of ``_sizes``) where a chunk that begins with it ends, exclusive.

    That is behind the last O, other than the chunk's first word, before the first word
    over the budget; without such an O, at that word.
    """
    at = np.arange(len(sizes))
    sums = np.concatenate(([0], np.cumsum(np.abs(sizes), dtype=np.int64)))
    full = np.maximum(np.searchsorted(sums, sums[:-1] + budget, "right") - 1, at + 1)
    last_o = np.maximum.accumulate(np.where(sizes < 0, at, -1)) if len(sizes) else at
    o = last_o[full - 1]
    return np.where((full < len(sizes)) & (o > at), o + 1, full)


def _bounds(sizes: Iterable[np.ndarray], stops: Iterable[int], starts: Iterable[int], budget: int) -> pd.Series:
    """The places before its stop where chunks begin, from its start on, and the end of the last one, of each array."""
    out = []
    for w, stop, start in zip(sizes, stops, starts, strict=True):
        cuts, places = _cuts(w, budget), [start]
        while places[-1] < stop:
            places.append(int(cuts[places[-1]]))
        out.append(places)
    return pd.Series(out, dtype=object)


def _exits(sizes: Iterable[np.ndarray], stops: Iterable[int], budget: int) -> pd.DataFrame:
    """For each of the first ``budget`` places of each array the first place from its stop on that going from cut to cut leads to, counted from there, and in how many steps; jumps are doubled until all are there."""
    exits, steps = [], []
    for w, stop in zip(sizes, stops, strict=True):
        cuts, at = _cuts(w, budget), np.arange(len(w) + 1)
        to, n = np.where(at < stop, np.append(cuts, len(w)), at), (at < stop).astype(np.int64)
        while (to[:stop] < stop).any():
            to, n = to[to], n + n[to]
        exits.append(to[: min(budget, len(w))] - stop)
        steps.append(n[: min(budget, len(w))])
    return pd.DataFrame({"exit": pd.Series(exits, dtype=object), "n": pd.Series(steps, dtype=object)})


def _bounds_of(w: Column, stop: Column, start: Column, budget: int) -> Column:
    def bounds(w: pd.Series, stop: pd.Series, start: pd.Series) -> pd.Series:
        return _bounds(w, stop, start, budget)

    return F.pandas_udf(bounds, "array<int>")(w, stop, start)


def _exits_of(w: Column, stop: Column, budget: int) -> Column:
    def exits(w: pd.Series, stop: pd.Series) -> pd.DataFrame:
        return _exits(w, stop, budget)

    return F.pandas_udf(exits, "exit array<int>, n array<int>")(w, stop)


def chunk_at_o(sentences: DataFrame, budget: int, tokens: str = "t") -> DataFrame:
    """``sentences`` with ``chunks``: array of struct(first, last) word positions, last exclusive.

    ``tokens`` is array<struct<label, size>>. A sentence over the budget is filled up to
    it and cut after the last O that isn't the chunk's first word, or else where it is
    full; a word larger than the budget makes a chunk of its own. Sizes under 1 and null
    ones count as 1; a sentence without words is one empty chunk, a null one null.
    """
    t = F.col(tokens)
    chunk = lambda first, last: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))
    w = F.coalesce(_sizes(t, budget), F.array().cast("array<int>"))
    rows = sentences.withColumn("_bounds", _bounds_of(w, F.size(w), F.lit(0), budget))
    cut = F.transform(F.slice("_bounds", 1, F.size("_bounds") - 1), lambda at, i: chunk(at, F.get("_bounds", i + 1)))
    return rows.withColumn("chunks", F.when(F.size(t) == 0, F.array(chunk(F.lit(0), F.lit(0)))).when(t.isNotNull(), cut)).drop("_bounds")


def chunk_rows_at_o(words: DataFrame, budget: int, segment: int = 8192, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, chunk_no, first, last``: the chunks of ``chunk_at_o`` for words as rows (``idx`` from 0 without gaps, ``label``, ``size``).

    A sequence may be of any length: a task gets ``segment`` words (at least ``budget``) and
    the ``budget`` that follow. As a chunk has at most ``budget`` words, a segment is entered
    at one of its first ``budget``, so each that has a next one becomes a table from these
    places to those where the next one is entered; only the tables are put in order by
    sequence. Words that are dealt in segments of this size are packed where they are: a
    number each is what gets exchanged. A segment that ``words`` already have must be of this size.
    """
    if segment < budget:
        segment, words = budget, words.drop(SEGMENT)
    packed = segmented(words, segment, keys).groupBy(SEGMENT).agg(F.array_sort(F.collect_list(F.struct("idx", "label", "size"))).alias("w"))
    packed = packed.select(SEGMENT, _sizes(F.col("w"), budget).alias("w"))
    of = lambda n: F.struct(*[F.col(f"{SEGMENT}.{k}").alias(k) for k in keys], n.alias("n"))
    number, none = F.col(f"{SEGMENT}.n"), F.lit(None).cast("array<int>")
    itself = F.struct(of(number).alias("s"), F.col("w").alias("w"), none.alias("ahead"))
    before = F.struct(of(number - 1).alias("s"), none.alias("w"), F.slice("w", 1, budget).alias("ahead"))
    pieces = packed.select(F.explode(F.when(number > 0, F.array(itself, before)).otherwise(F.array(itself))).alias("e")).select(F.col("e.s").alias(SEGMENT), "e.w", "e.ahead")
    parts = pieces.groupBy(SEGMENT).agg(F.first("w", ignorenulls=True).alias("w"), F.first("ahead", ignorenulls=True).alias("ahead"))
    parts = parts.select(SEGMENT, F.size("w").alias("own"), F.concat("w", F.coalesce("ahead", F.array().cast("array<int>"))).alias("w"), F.col("ahead").isNotNull().alias("goes_on"))

    tables = parts.where("goes_on").select(SEGMENT, _exits_of(F.col("w"), F.col("own"), budget).alias("e")).select(SEGMENT, "e.exit", "e.n")
    key = [F.col(f"{SEGMENT}.{k}").alias(f"_key_{i}") for i, k in enumerate(keys)]
    lists = tables.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(number.alias("at"), of(number + 1).alias("next"), "exit", "n"))).alias("t"))
    at = lambda entry, before: F.struct(entry.cast("int").alias("entry"), before.cast("long").alias("before"))
    start = F.struct(at(F.lit(0), F.lit(0)).alias("now"), F.array().cast("array<struct<entry:int,before:bigint>>").alias("out"))

    def enter(acc: Column, x: Column) -> Column:
        now = at(F.get(x["exit"], acc["now"]["entry"]), acc["now"]["before"] + F.get(x["n"], acc["now"]["entry"]))
        return let(now, lambda v: F.struct(v.alias("now"), F.concat(acc["out"], F.array(v)).alias("out")))

    entries = F.aggregate("t", start, enter, lambda acc: acc["out"])
    entered = lists.select(F.explode(F.arrays_zip(F.transform("t", lambda x: x["next"]).alias("s"), entries.alias("v"))).alias("e")).select(F.col("e.s").alias(SEGMENT), "e.v.entry", "e.v.before")

    out = parts.join(entered, SEGMENT, "left").select(SEGMENT, F.coalesce("before", F.lit(0)).alias("before"), _bounds_of(F.col("w"), F.col("own"), F.coalesce("entry", F.lit(0)), budget).alias("b"))
    out = out.select(SEGMENT, "before", "b", F.posexplode(F.slice("b", 1, F.size("b") - 1)).alias("nth", "at"))
    base = number * segment
    return out.select(*[F.col(f"{SEGMENT}.{k}").alias(k) for k in keys], (F.col("before") + F.col("nth")).alias("chunk_no"), (base + F.col("at")).alias("first"), (base + F.get("b", F.col("nth") + 1)).alias("last"))


def overlapping_windows(rows: DataFrame, ids: str = "ids", length: int = 256, stride: int = 128, least: int = 7, special: int = 2) -> DataFrame:
    """Each row's id array as windows that overlap by ``stride``. Adds window_no and window.

    ``length`` and ``least`` count the ``special`` ids that a model puts around each
    window, which ``ids`` don't have: a window holds that many fewer, and windows under
    ``least`` are dropped.
    """
    room = length - special
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - F.lit(stride) - 1, F.lit(0)), F.lit(room - stride))
    out = rows.select("*", F.posexplode(starts).alias("window_no", "_at")).withColumn("window", F.slice(ids, F.col("_at") + 1, room)).drop("_at")
    return long_enough(out, "window", least - special)


def long_enough(rows: DataFrame, ids: str = "ids", least: int = 7) -> DataFrame:
    """Rows whose id array has ``least`` or more."""
    return rows.where(F.size(ids) >= least)


def hash_holdout(rows: DataFrame, *keys: str, share: float = 0.1) -> DataFrame:
    """``rows`` with ``split``: eval for about ``share`` of the keys' hashes, else train."""
    part = F.conv(F.substr(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys])), F.lit(1), F.lit(6)), 16, 10).cast("long")
    return rows.withColumn("split", F.when(part < int(share * 16**6), "eval").otherwise("train"))


def first_subword_labels(words: DataFrame, label_ids: dict[str, int], ignored: int = -100) -> DataFrame:
    """``words`` (``subwords`` array, ``label``) as subwords with ``label_id`` on each word's first."""
    ids = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in label_ids.items()], F.lit(ignored))
    rows = words.select("*", F.posexplode("subwords").alias("sub_no", "subword"))
    return rows.withColumn("label_id", F.when(F.col("sub_no") == 0, ids).otherwise(ignored)).drop("subwords")


def decided_labels(rows: DataFrame, scores: str = "scores", label_id: str = "label_id", ignored: int = -100) -> DataFrame:
    """Rows whose label isn't ignored, with ``predicted``: the first place of the greatest score."""
    return rows.where(F.col(label_id) != ignored).withColumn("predicted", F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def regroup_subwords(rows: DataFrame, special: tuple[str, ...] = ("[CLS]", "[SEP]", "[PAD]")) -> DataFrame:
    """``doc_id, word_no, word`` of ``doc_id, idx, subword``: ``##`` goes on, special pieces don't count."""
    kept = rows.where(~F.col("subword").isin(*special))
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.withColumn("word_no", F.sum((~F.startswith("subword", F.lit("##"))).cast("int")).over(order))
    parts = kept.groupBy("doc_id", "word_no").agg(F.array_sort(F.collect_list(F.struct("idx", F.regexp_replace("subword", "^##", "").alias("s")))).alias("p"))
    return parts.select("doc_id", "word_no", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("word"))


#: Characters of the blocks that long texts are read in.
TEXT_BLOCK = 16_384


def text_windows(rows: DataFrame, text: str = "text", size: int = 1500, back: int = 200) -> DataFrame:
    """``rows`` as ``chunk_no, chunk_start, chunk``: texts over ``size`` cut behind the last ``". "`` (else space) of the last ``back`` characters, the next one starting ``back`` before the cut.

    Where one ends depends on the one before, so the cuts are a fold over at most as
    many steps as the text has strides. A step looks at two blocks of the text, so the
    time grows with the text, and chunks leave the fold as they are, not as places that
    are looked up in the text once more.
    """
    t = F.col(text)
    stride = size - 2 * back
    block = max(TEXT_BLOCK, size)
    kind = "array<struct<start:int,chunk:string>>"
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / block).cast("int")), lambda i: F.substr(t, i * block + 1, F.lit(block)))
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("done"), F.array().cast(kind).alias("out"))

    def cuts(whole_text: Column) -> Column:
        parts, all_ = whole_text["parts"], whole_text["n"]

        def step(acc: Column, _: Column) -> Column:
            nth = F.floor(acc["pos"] / block).cast("int")
            here = F.concat(F.get(parts, nth), F.coalesce(F.get(parts, nth + 1), F.lit("")))
            return F.when(acc["done"], acc).otherwise(let(F.substr(here, acc["pos"] - nth * block + 1, F.lit(size)), lambda piece: _cut(acc, piece)))

        def _cut(acc: Column, piece: Column) -> Column:
            n = F.length(piece)
            last = acc["pos"] + size >= all_
            skip = F.greatest(n - back, F.lit(0))

            def with_tail(tail: Column) -> Column:
                dot, space = F.instr(tail, " ."), F.instr(tail, " ")  # in the tail from behind
                stop = F.when(last, n).when(dot > 0, n - dot + 1).when(space > 0, n - space + 1).otherwise(n)
                return let(stop, lambda s: F.struct(
                    F.when(last, all_).otherwise(acc["pos"] + F.greatest(F.lit(1), s - back)).alias("pos"), last.alias("done"),
                    F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), F.substr(piece, F.lit(1), s).alias("chunk")))).alias("out"),
                ))

            return let(F.reverse(F.substr(piece, skip + 1, n - skip)), with_tail)

        steps = F.sequence(F.lit(0), F.ceil(all_ / F.lit(stride)).cast("int"))
        return F.aggregate(steps, start, step, lambda a: a["out"])

    whole = F.array(F.struct(F.lit(0).alias("start"), t.alias("chunk")))
    out = rows.select("*", F.posexplode(F.when(F.length(t) <= size, whole).otherwise(let(F.struct(blocks.alias("parts"), F.length(t).alias("n")), cuts))).alias("chunk_no", "_c"))
    return out.withColumn("chunk_start", F.col("_c.start")).withColumn("chunk", F.col("_c.chunk")).drop("_c")


def merge_chunk_entities(found: DataFrame) -> DataFrame:
    """Entities found in overlapping chunks once each, by their place in the whole text (``start``, ``end``); the earliest chunk's stays."""
    first = Window.partitionBy("doc_id", "start", "end").orderBy("chunk_no")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

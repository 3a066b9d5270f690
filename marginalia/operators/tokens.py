"""Documents to tokens, and what a token sees beside it. All windows share one exchange by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marginalia.functions.arrays import let
from marginalia.functions.text import MIDDLE_DOT, clean_text, is_word, pieces, token_of, tokens_in
from marginalia.operators.segments import SEGMENT, carried, segmented

#: What a segment's tokens see beyond it: the word before, whether that comes after the last stop, and the word after.
AROUND = "_around"
#: What tells one sequence of tokens from another.
DOC = ("doc_id",)


def by_doc(keys: tuple[str, ...] = DOC) -> WindowSpec:
    """A document's tokens in order."""
    return Window.partitionBy(*keys).orderBy("idx")


def so_far(keys: tuple[str, ...] = DOC) -> WindowSpec:
    """A document's tokens up to this one."""
    return by_doc(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Parts of texts for each part that the session has for shuffles.
PARTS = 8


def dealt(rows: DataFrame, *by: str, parts: int = PARTS) -> DataFrame:
    """``rows`` in ``parts`` times as many parts as the session has for shuffles, which stay apart however small.

    Texts fall into tokens that are sorted in the same task and take many times the
    room, so parts by the size of the texts would be sorted on disk.
    """
    return rows.repartition(parts * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def tokenize(docs: DataFrame, id: str = "doc_id", text: str = "text", clean: bool = True, keyed: bool = False, segment: int | None = None, around: bool = False, parts: int = PARTS) -> DataFrame:
    """``doc_id, idx, text, is_word``: tokens in order; null and blank texts have none.

    ``keyed``: documents are dealt by id before they fall into tokens, so that windows
    and groups by document need no exchange of the tokens, in ``parts`` as ``dealt``
    has them. ``segment``: they fall into
    segments of so many tokens first, which are dealt out, and tokens have theirs;
    ``around``: and what ``beside`` needs from the segments near them, so that it doesn't
    have to ask for it.
    """
    source = clean_text(F.col(text)) if clean else F.col(text)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text))
    if segment:
        # texts are dealt first, as few tasks read them; a filter would take them apart once more
        every = dealt(rows, "doc_id").select("doc_id", tokens_in(source).alias("every"))
        starts = F.when(F.size("every") > 0, F.sequence(F.lit(0), F.floor((F.size("every") - 1) / segment).cast("int")))
        near = _around(F.col("every"), segment) if around else F.lit(None)
        every = every.select("doc_id", "every", starts.alias("starts"), near.alias("near"))
        piece = lambda n: F.struct(n.cast("long").alias("n"), F.slice("every", n * segment + 1, segment).alias("some"), *([F.get("near", n).alias("near")] if around else []))
        parts = every.select("doc_id", F.explode(F.transform("starts", piece)).alias("p"))
        more = [AROUND] if around else []
        parts = parts.select(F.struct("doc_id", "p.n").alias(SEGMENT), F.col("p.some").alias("some"), *[F.col("p.near").alias(c) for c in more])
        parts = dealt(parts, SEGMENT)
        rows = parts.select(SEGMENT, *more, F.posexplode("some").alias("at", "text"))
        rows = rows.select(f"{SEGMENT}.doc_id", (F.col(f"{SEGMENT}.n") * segment + F.col("at")).cast("int").alias("idx"), "text", SEGMENT, *more)
        return rows.select("doc_id", "idx", "text", is_word(F.col("text")).alias("is_word"), SEGMENT, *more)
    rows = dealt(rows, "doc_id", parts=parts) if keyed else rows
    rows = rows.select("doc_id", F.posexplode(tokens_in(source)).alias("idx", "text"))
    return rows.select("doc_id", "idx", "text", is_word(F.col("text")).alias("is_word"))


def _around(every: Column, segment: int) -> Column:
    """AROUND for each segment of an array of tokens; null for a text of one segment."""
    starts = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / segment).cast("int"))

    def ends(n: Column) -> Column:
        some = F.filter(F.slice(every, n * segment + 1, segment), lambda t: is_word(t) | is_stop(t))
        return let(some, lambda s: let(F.filter(s, lambda t: ~is_stop(t)), lambda w: F.struct(F.try_element_at(w, F.lit(-1)).alias("last"), (~is_stop(F.try_element_at(s, F.lit(-1)))).alias("goes_on"), F.get(w, 0).alias("first"))))

    def near(e: Column, n: Column) -> Column:
        # nearly always the next segment has it
        before = lambda c: F.when(n > 0, F.coalesce(F.get(e, n - 1)[c], F.try_element_at(F.filter(F.transform(F.slice(e, 1, n), lambda x: x[c]), lambda v: v.isNotNull()), F.lit(-1))))
        after = F.coalesce(F.get(e, n + 1)["first"], F.get(F.filter(F.transform(F.slice(e, n + 2, F.size(e)), lambda x: x["first"]), lambda v: v.isNotNull()), 0))
        return F.struct(before("last").alias("prev"), before("goes_on").alias("goes_on"), after.alias("next"))

    return F.when(F.size(every) > segment, let(F.transform(starts, ends), lambda e: F.transform(starts, lambda n: near(e, n))))


def having(docs: DataFrame, rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """The documents that ``rows`` (with ``doc_id``) have something of."""
    return docs.join(rows.select(F.col("doc_id").alias(id)).distinct(), id, "left_semi")


def tokenize_with_offsets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``tokenize``, with ``start`` and ``end`` in code points of the cleaned text; pieces tile it, so ends are running sums."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text)).repartition("doc_id").select("doc_id", F.posexplode(pieces(clean_text(F.col(text)))).alias("idx", "piece"))
    rows = rows.withColumn("text", token_of(F.col("piece"))).withColumn("end", F.sum(F.length("piece")).over(so_far()).cast("int"))
    return rows.select("doc_id", "idx", "text", (F.col("end") - F.length("text")).alias("start"), "end", is_word(F.col("text")).alias("is_word"))


def is_stop(token: Column) -> Column:
    return token.isin(".", "!", "?")


def beside(tokens: DataFrame, segment: int | None = None) -> DataFrame:
    """All tokens; words get prev_word, next_word (marks between don't matter) and sentence_initial, marks get nulls.

    Sentence-initial: no word before, or a stop since the last one. Words look past the
    marks by the document's one order, so tokens are sorted once, here and for what follows.
    With ``segment``, documents are dealt out in segments of so many tokens, and rows have theirs;
    what they see beyond it is in AROUND, or else asked for from the other segments.
    """
    known = AROUND in tokens.columns
    if segment and not known:
        word, stop = F.when(F.col("is_word"), F.struct("idx", "text")), F.when(is_stop(F.col("text")), F.col("idx"))
        rows = carried(segmented(tokens, segment), {"_prev": word, "_stop": stop}, {"_next": word})
        first = F.col("_prev").isNull() | F.coalesce(F.col("_stop") > F.col("_prev.idx"), F.lit(False))
        found = {"prev_word": F.col("_prev.text"), "next_word": F.col("_next.text"), "sentence_initial": first}
        return rows.withColumns({c: F.when(F.col("is_word"), v) for c, v in found.items()}).drop("_prev", "_stop", "_next")
    order = by_doc((SEGMENT,) if known else DOC)
    rows = tokens.withColumns({"_word": F.when(F.col("is_word"), F.col("text")), "_goes_on": F.when(F.col("is_word"), True).when(is_stop(F.col("text")), False)})
    near = lambda f, c: F.expr(f"{f}({c}) IGNORE NULLS").over(order)
    rows = rows.withColumns({"prev_word": near("lag", "_word"), "next_word": near("lead", "_word"), "_goes_on": near("lag", "_goes_on")})
    if known:
        rows = rows.withColumns({c: F.coalesce(c, f"{AROUND}.{side}") for c, side in (("prev_word", "prev"), ("next_word", "next"), ("_goes_on", "goes_on"))}).drop(AROUND)
    rows = rows.withColumn("sentence_initial", ~F.coalesce("_goes_on", F.lit(False))).drop("_word", "_goes_on")
    return rows.withColumns({c: F.when(F.col("is_word"), F.col(c)) for c in ("prev_word", "next_word", "sentence_initial")})


def with_neighbours(tokens: DataFrame, segment: int | None = None) -> DataFrame:
    """The word tokens, as ``beside`` gives them."""
    return beside(tokens, segment).where("is_word")


def word_ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """``doc_id, start_idx, span_len, ngram``: spans of 1 to ``n`` words that follow each other, whatever marks stand between."""
    words = tokens.where("is_word")
    ahead = F.collect_list("text").over(by_doc().rowsBetween(0, n - 1))
    places = F.collect_list("idx").over(by_doc().rowsBetween(0, n - 1))
    spans = words.select("doc_id", "idx", ahead.alias("w"), places.alias("at"))
    spans = spans.select("doc_id", F.col("idx").alias("start_idx"), "w", "at", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("span_len"))
    return spans.select("doc_id", "start_idx", "span_len", F.array_join(F.slice("w", 1, F.col("span_len")), " ").alias("ngram"), F.slice("at", 1, F.col("span_len")).alias("token_indices"))


#: Words whose spans are made in one task; those of a longer text are dealt out.
SPAN_WORDS = 500


def stretches_within(tokens: DataFrame, reach: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Stretches of SPAN_WORDS words of the documents that ``reach`` (``doc_id, n`` and further columns) has, each as an array ``w`` of ``idx, text`` and ``more``, with the few words that spans of ``n`` words reach into; dealt out, with ``at``, the place of the first."""
    rest = [c for c in reach.columns if c not in ("doc_id", "n")]
    words = tokens.where("is_word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", *(more or [])))).alias("w")).join(reach, "doc_id")
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(SPAN_WORDS))
    parts = words.select("doc_id", "n", *rest, F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("w", i + 1, F.col("n") + (SPAN_WORDS - 1)).alias("w")))).alias("s"))
    return dealt(parts.select("doc_id", "n", *rest, "s.at", "s.w"), "doc_id", "at")


def spans_within(tokens: DataFrame, reach: DataFrame) -> DataFrame:
    """As ``word_ngrams``, each document with its own greatest number of words: ``reach`` (``doc_id, n``); documents without one have no spans.

    Further columns of ``reach`` go along with the spans. Texts are dealt out in
    stretches of SPAN_WORDS words, each with the few that its last spans reach into, so
    no task gets all spans of a long text.
    """
    rest = [c for c in reach.columns if c not in ("doc_id", "n")]
    parts = stretches_within(tokens, reach)
    own = F.sequence(F.lit(1), F.least(F.size("w"), F.lit(SPAN_WORDS)))
    parts = parts.select("doc_id", *rest, F.explode(F.transform(own, lambda i: F.slice("w", i, F.col("n")))).alias("p"))
    spans = parts.select("doc_id", *rest, F.element_at("p", 1)["idx"].alias("start_idx"), "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("span_len")).withColumn("p", F.slice("p", 1, F.col("span_len")))
    return spans.select("doc_id", "start_idx", "span_len", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("ngram"), F.transform("p", lambda x: x["idx"]).alias("token_indices"), *rest)


def resplit(tokens: DataFrame) -> DataFrame:
    """Tokens whose ordinal signs become spaces, split again; a label goes to every piece. ``doc_id, idx, text, label``, numbered anew."""
    parts = tokens.select("doc_id", F.col("idx").alias("old"), F.posexplode(F.transform(pieces(F.translate("text", "º°", "  ")), token_of)).alias("part", "text"), "label")
    return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("old", "part")) - 1).alias("idx"), "text", "label")


def detokenize(tokens: DataFrame) -> DataFrame:
    """``doc_id, text``: tokens in order, joined by spaces."""
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def edition_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", strip_middle_dots: bool = True) -> DataFrame:
    """Non-empty stripped texts."""
    from marginalia.functions.text import strip

    c = strip(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(id).alias("doc_id"), (F.replace(c, F.lit(MIDDLE_DOT), F.lit("")) if strip_middle_dots else c).alias("text"), c.alias("whole"))
    return rows.where("whole <> ''").drop("whole")

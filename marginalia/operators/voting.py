"""Signals to BIO labels: a small state machine, written as windows over a document's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.lexicon import continues_person
from marginalia.operators.segments import SEGMENT, greatest_before, segmented
from marginalia.operators.signals import Lexicons
from marginalia.operators.tokens import DOC, by_doc

SIGNALS = ("s1", "s2", "s3")
NAMES = ("signal_1", "signal_2", "signal_3")


def combine(tokens: DataFrame, signals: dict[str, DataFrame | None]) -> DataFrame:
    """Tokens with columns s1, s2, s3: each signal's ``label`` by document and index, null where it has none."""
    for name in SIGNALS:
        found = signals.get(name)
        tokens = tokens.withColumn(name, F.lit(None).cast("string")) if found is None else tokens.join(found.where("label is not null").select("doc_id", "idx", F.col("label").alias(name)), ["doc_id", "idx"], "left")
    return tokens


#: The states of the vote.
STATES = (None, "Person", "Location")


def _typed(signal: Column) -> Column:
    return F.when(signal.isin("Person", "Location"), signal)


def _case(signals: list[Column], lex: Lexicons) -> Column:
    """What kind of token this is to the vote, from its signals, its text and whether it is a word."""
    low, kind = F.lower("text"), F.coalesce(*[_typed(c) for c in signals])
    in_ = lambda words: low.isin(*words) if words else F.lit(False)
    case = F.when(~F.col("is_word"), "not_word").when(F.coalesce(*signals).isNull(), F.when(continues_person(F.col("text")), "patronymic").otherwise("no_signal")).when(kind.isNull(), "unknown")
    return case.when((kind == "Person") & in_(lex.title_words), "title").when((kind == "Location") & in_(lex.place_prefixes), "prefix").otherwise("entity")


def _keeps(case: Column) -> Column:
    return F.when(case.isin("patronymic", "title"), "Person").when(case == "prefix", "Location")


def _before(name: str, keeps: Column, sets: Column, keys: tuple[str, ...]) -> dict[str, Column]:
    """What the last setter before a token gave (empty for no type), and for each type whether a keeper of the other has come since. All of one frame, so one pass over the tokens."""
    latest = lambda c: F.last(c, ignorenulls=True).over(by_doc(keys).rowsBetween(Window.unboundedPreceding, -1))
    own = lambda other: latest(F.when(keeps.isNull(), True).when(keeps == other, False))
    return {f"_set{name}": latest(F.when(keeps.isNull(), F.coalesce(sets, F.lit("")))), f"_person{name}": own("Location"), f"_location{name}": own("Person")}


def _stood(name: str, entry: Column) -> Column:
    """The state before a token, from ``_before``; ``entry``: the one that its sequence begins in."""
    given, stands = F.coalesce(f"_set{name}", entry), lambda kind: F.coalesce(f"_{kind}{name}", F.lit(True))
    return F.when(((given == "Person") & stands("person")) | ((given == "Location") & stands("location")), given)


def _stood_in_segments(rows: DataFrame, keeps: Column, sets: Column, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` (of ``segmented``) with ``_stood``, from the place and type of the last setter and the places of the last keepers, whatever segment they are in."""
    n, at = len(STATES), F.col("idx").cast("long")
    which = F.when(sets == STATES[1], 1).when(sets == STATES[2], 2).otherwise(0)
    places = {"_set": F.when(keeps.isNull(), at * n + which), "_person": F.when(keeps == "Person", at), "_location": F.when(keeps == "Location", at)}
    rows = greatest_before(rows, places, keys)
    none_since = lambda c: F.coalesce(F.col(c) < F.floor(F.col("_set") / n), F.lit(True))
    which = F.pmod("_set", F.lit(n))
    return rows.withColumn("_stood", F.when((which == 1) & none_since("_location"), STATES[1]).when((which == 2) & none_since("_person"), STATES[2]))


def _state(keeps: Column, sets: Column, stood: Column) -> Column:
    return F.when(keeps.isNull(), sets).when(keeps == stood, keeps)


def _label(state: Column, stood: Column) -> Column:
    return F.when(state.isNull(), "O").otherwise(F.concat(F.when(F.coalesce(stood == state, F.lit(False)), "I-").otherwise("B-"), state))


def labels_of_ways(tokens: DataFrame, lex: Lexicons, ways: dict[str, tuple[Column, ...]], keys: tuple[str, ...] = DOC) -> DataFrame:
    """``tokens`` (``keys, idx, text, is_word``) with a column for each of ``ways``: the label that ``vote`` gives for these signals. One pass over the tokens serves all ways."""
    low, sides, found = F.lower("text"), {}, {}
    in_ = lambda words: low.isin(*words) if words else F.lit(False)
    # what all ways ask of a word is a column of its own: a stage whose code repeats it for each way is too long to be compiled
    about = {"_goes": continues_person(F.col("text")), "_title": in_(lex.title_words), "_prefix": in_(lex.place_prefixes)}
    for i, signals in enumerate(ways.values()):
        kind = F.coalesce(*[_typed(c) for c in signals])
        keeps = F.when(~F.col("is_word"), None).when(F.coalesce(*signals).isNull(), F.when(F.col("_goes"), "Person"))
        sides[f"_keeps{i}"] = keeps.when((kind == "Person") & F.col("_title"), "Person").when((kind == "Location") & F.col("_prefix"), "Location")
        sides[f"_to{i}"] = F.when(F.col("is_word"), kind)
        found |= _before(str(i), F.col(f"_keeps{i}"), F.col(f"_to{i}"), keys)
    rows = tokens.withColumns(about).withColumns(sides).withColumns(found)
    rows = rows.withColumns({f"_stood{i}": _stood(str(i), F.lit(None).cast("string")) for i in range(len(ways))})
    label = lambda i: _label(_state(F.col(f"_keeps{i}"), F.col(f"_to{i}"), F.col(f"_stood{i}")), F.col(f"_stood{i}"))
    return rows.select(*keys, "idx", "text", "is_word", *[label(i).alias(n) for i, n in enumerate(ways)])


def vote(combined: DataFrame, lex: Lexicons, keys: tuple[str, ...] = DOC, segment: int | None = None) -> DataFrame:
    """``doc_id, idx, text, is_word, label, reason, signals, resolved_type, type_source, type_disagreement``.

    Each token either sets the state (a type, or none) or keeps one type if it stands:
    an unsignalled patronymic keeps a person, a title word typed Person and a prefix
    typed Location keep their own. A run of keepers takes the state that was set before
    it as long as all agree with it. A label begins with I where the state goes on.
    ``keys`` tell sequences apart where a document has several. With ``segment``,
    sequences are dealt out in segments of so many tokens, each of which gets the last
    setter and keepers of those before it; rows have their segment.
    """
    typed = lambda c: _typed(F.col(c))
    kind = F.coalesce(*[typed(c) for c in SIGNALS])
    rows = combined.withColumn("type", F.when(F.col("is_word"), kind)).withColumn("case", _case([F.col(c) for c in SIGNALS], lex))
    rows = rows.withColumn("keeps", _keeps(F.col("case")))
    set_to = F.when(F.col("keeps").isNull() & (F.col("case") == "entity"), F.col("type"))
    rows, out = rows.withColumn("_to", set_to), [*keys]
    if segment:
        rows = _stood_in_segments(segmented(rows, segment, keys), F.col("keeps"), F.col("_to"), keys)
        out = [SEGMENT, *keys]
    else:
        rows = rows.withColumns(_before("", F.col("keeps"), F.col("_to"), keys)).withColumn("_stood", _stood("", F.lit(None).cast("string")))
    rows = rows.withColumn("state", _state(F.col("keeps"), F.col("_to"), F.col("_stood")))
    label = _label(F.col("state"), F.col("_stood"))
    reason = (
        F.when(F.col("case") == "not_word", "not_word").when(F.col("case") == "patronymic", F.when(F.col("state").isNull(), "no_signal").otherwise("patronymic_continuation")).when(F.col("case") == "no_signal", "no_signal")
        .when(F.col("case") == "unknown", "only_capitalisation_unknown_type").when(F.col("state").isNotNull(), "voted_entity").when(F.col("case") == "title", "title_stripped").otherwise("location_prefix_stripped")
    )
    present = F.when(F.col("is_word"), F.concat_ws("+", *[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(SIGNALS, NAMES, strict=True)])).otherwise("")
    votes = F.size(F.array_distinct(F.filter(F.array(*SIGNALS), lambda x: x.isin("Person", "Location"))))
    source = F.when(F.col("is_word"), F.coalesce(*[F.when(typed(c).isNotNull(), F.lit(n)) for c, n in zip(SIGNALS, NAMES, strict=True)]))
    return rows.select(*out, "idx", "text", "is_word", label.alias("label"), reason.alias("reason"), present.alias("signals"), F.col("type").alias("resolved_type"), source.alias("type_source"), (F.col("is_word") & (votes > 1)).alias("type_disagreement"))


def signal_details(entity: DataFrame | None = None, names: DataFrame | None = None, capitals: DataFrame | None = None) -> DataFrame:
    """``doc_id, idx, signal_1, signal_2, signal_3``: what each signal says of a token, for the vote's log; null where it says nothing.

    Of ``project_entities`` (label, place in the entity, level and score, and the
    entity's number), ``name_lists`` (label, name, score, level) and ``capitals``
    (label, status). Tokens without a signal have no row.
    """
    parts = (
        (entity, ("label", "bio_position", "level", "score", "ord"), "label is not null"), (names, ("label", "name", "score", "level", "source"), "label is not null"),
        (capitals, ("label", "status"), "label is not null"),
    )
    out = None
    for name, (rows, columns, said) in zip(NAMES, parts, strict=True):
        if rows is None:
            continue
        found = rows.where(said).select("doc_id", "idx", F.struct(*columns).alias(name))
        out = found if out is None else out.join(found, ["doc_id", "idx"], "full_outer")
    return out


def signal_combinations(voted: DataFrame) -> DataFrame:
    return voted.where("reason = 'voted_entity'").groupBy("signals").agg(F.count("*").alias("n"))


def vote_summary(voted: DataFrame, by: str = "doc_id") -> DataFrame:
    label = F.col("label")
    return voted.groupBy(by).agg(
        F.count("*").alias("total_tokens"), F.count_if("is_word").alias("word_tokens"), F.count_if(label != "O").alias("entity_tokens"), F.count_if(F.contains(label, F.lit("Person"))).alias("person_tokens"),
        F.count_if(F.contains(label, F.lit("Location"))).alias("location_tokens"), F.count_if(label == "O").alias("o_tokens"),
        F.count_if(F.col("type_disagreement") & (F.col("reason") == "voted_entity")).alias("type_disagreements"), F.count_if(F.col("reason") == "only_capitalisation_unknown_type").alias("cap_only_unknown"),
    )


def review_unknown(voted: DataFrame) -> DataFrame:
    """``doc_id, text, n, first_idx``: tokens that only a capital speaks for, by first sight in each document."""
    found = voted.where("reason = 'only_capitalisation_unknown_type'")
    return found.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))

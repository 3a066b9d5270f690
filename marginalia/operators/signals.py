"""Three kinds of evidence that a token belongs to a name: projected entities, name lists, capitals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.lexicon import is_capitalised, is_patronymic, is_roman, stop_reason
from marginalia.functions.similarity import bag_may_reach  # noqa: F401 the filter of matching, as an expression
from marginalia.functions.text import consonant_skeleton
from marginalia.operators import gazetteer
from marginalia.operators import tokens as tk
from marginalia.operators.matching import matcher
from marginalia.operators.tokens import beside


@dataclass(frozen=True)
class Lexicons:
    """Word lists, all given by the user."""

    stop_first: list[str] = field(default_factory=list)
    stop_second: list[str] = field(default_factory=list)
    cap_first: list[str] = field(default_factory=list)
    cap_second: list[str] = field(default_factory=list)
    locatives: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    admin_suffixes: list[str] = field(default_factory=list)
    title_words: list[str] = field(default_factory=list)
    place_prefixes: list[str] = field(default_factory=list)


def _in(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.isin(*words), F.lit(False)) if words else F.lit(False)


def mark_capitals(tokens: DataFrame, lex: Lexicons, segment: int | None = None) -> DataFrame:
    """All tokens with ``status`` (roman_numeral, sentence_initial, stop_first, stop_second, candidate; null without a capital) and ``label`` for candidates.

    The tests come in this order. A candidate's type follows from its neighbours:
    locative before, patronymic itself or next, title before, administrative word
    after; else it is Unknown. With ``segment``, documents are dealt out in segments of
    so many tokens.
    """
    rows, t = beside(tokens, segment), F.col("text")
    status = F.when(~F.col("is_word") | ~is_capitalised(t), None).when(is_roman(t), "roman_numeral").when(F.col("sentence_initial"), "sentence_initial")
    status = status.when(_in(t, lex.cap_first), "stop_first").when(_in(t, lex.cap_second), "stop_second").otherwise("candidate")
    before, after = F.lower("prev_word"), F.lower("next_word")
    kind = F.when(_in(before, lex.locatives), "Location").when(is_patronymic(t) | F.coalesce(is_patronymic(F.col("next_word")), F.lit(False)) | _in(before, lex.titles), "Person")
    kind = kind.when(_in(after, lex.admin_suffixes), "Location").otherwise("Unknown")
    rows = rows.withColumn("status", status)
    return rows.withColumn("label", F.when(F.col("status") == "candidate", kind))


def capitals(tokens: DataFrame, lex: Lexicons) -> DataFrame:
    """The word tokens of ``mark_capitals``."""
    return mark_capitals(tokens, lex).where("is_word")


def capitals_summary(found: DataFrame) -> DataFrame:
    """Counts of candidates by fate and type."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return found.agg(
        is_("status", "candidate").alias("candidates"), F.count_if(F.col("status").isin("stop_first", "stop_second")).alias("stoplisted"), is_("status", "roman_numeral").alias("roman_numerals"),
        is_("status", "sentence_initial").alias("sentence_initial"), F.count_if(F.col("label").isin("Person", "Location")).alias("typed"), is_("label", "Unknown").alias("untyped"),
        is_("label", "Person").alias("person"), is_("label", "Location").alias("location"),
    )


def _named(rows: DataFrame, loc: Column, per: Column, lex: Lexicons, keep: list[str]) -> DataFrame:
    """``rows`` with the verdict on each word's two hits (structs of score, level and name, null for none)."""
    found = rows.select(*[F.col(c) for c in keep], loc.alias("_loc"), per.alias("_per"), F.when(F.col("is_word"), stop_reason(F.col("text"), lex.stop_first or [""], lex.stop_second or [""], ("stop_first", "stop_second"))).alias("stop"))
    s_loc, s_per = F.coalesce("_loc.score", F.lit(-1.0)), F.coalesce("_per.score", F.lit(-1.0))
    hit = (F.greatest(s_loc, s_per) >= 0) & F.col("stop").isNull()  # few words are in a list, so few are held against the stop lists
    place = s_loc >= s_per
    exact = lambda kind: F.col(f"{kind}.level") == "exact"
    return found.select(
        *keep, "stop", exact("_loc").alias("loc_exact"), exact("_per").alias("per_exact"), F.when(hit, F.when(place, "Location").otherwise("Person")).alias("label"),
        F.when(hit, F.when(place, "places").otherwise("persons")).alias("source"), F.when(hit, F.greatest(s_loc, s_per)).alias("score"),
        F.when(hit, F.when(exact("_loc") | exact("_per"), "exact").otherwise("fuzzy")).alias("level"), (hit & (s_loc >= 0) & (s_per >= 0)).alias("conflict"),
        F.when(hit, F.when(place, F.col("_loc.name")).otherwise(F.col("_per.name"))).alias("name"),
    )


def _keyed(tokens: DataFrame) -> DataFrame:
    """Tokens with ``_low``, the word to look up; marks get keys that no name has, dealt over many, so that they don't meet in one task."""
    deal = F.concat(F.lit("\n"), F.pmod(F.xxhash64("doc_id", "idx"), F.lit(4096)).cast("string"))
    return tokens.withColumn("_low", F.when(F.col("is_word"), F.lower("text")).otherwise(deal))


def mark_names(tokens: DataFrame, places: DataFrame, persons: DataFrame, lex: Lexicons, fuzzy: bool = True, words: DataFrame | None = None) -> DataFrame:
    """All tokens with ``stop`` and, unless stopped, ``label, source, score, level, conflict, name``; marks have none.

    Both hit: the higher score wins, a tie is a Location. A similar (not exact) hit
    counts only for a token that is capitalised and long enough itself. Exact names
    are looked up from the tokens at once; only similar ones need the distinct words,
    which are those of ``words`` if ``tokens`` have been joined with more.
    """
    if not fuzzy:
        rows = gazetteer.with_names(_keyed(tokens), gazetteer.name_table({"_in_loc": places, "_in_per": persons}), "_low")
        hit = lambda c: F.when(F.col(c), F.struct(F.lit(100.0).alias("score"), F.lit("exact").alias("level"), F.col("_low").alias("name")))
        return _named(rows, hit("_in_loc"), hit("_in_per"), lex, tokens.columns)
    hits = gazetteer.lookup_lists(tokens if words is None else words, {"_loc": places, "_per": persons}, [*lex.stop_first, *lex.stop_second])
    rows = gazetteer.with_hits(_keyed(tokens), hits, "_low")
    own = is_capitalised(F.col("text")) & (F.length("text") >= gazetteer.MIN_LENGTH)
    of = lambda kind: F.when((F.col(f"{kind}.level") == "exact") | own, F.col(kind))
    return _named(rows, of("_loc"), of("_per"), lex, tokens.columns)


def exact_labels(tokens: DataFrame, table: DataFrame, ways: dict[str, tuple[str, str]], lex: Lexicons) -> DataFrame:
    """Tokens with a column for each of ``ways`` (column: names of the two list columns of ``table``, places and persons): the label of exact hits.

    One look-up, in one ``gazetteer.name_table``, serves all ways.
    """
    rows = gazetteer.with_names(_keyed(tokens), table, "_low")
    stopped = stop_reason(F.col("text"), lex.stop_first or [""], lex.stop_second or [""], ("stop_first", "stop_second")).isNotNull()
    label = lambda loc, per: F.when((F.col(loc) | F.col(per)) & F.col("is_word") & ~stopped, F.when(F.col(loc), "Location").otherwise("Person"))
    return rows.select(*tokens.columns, *[label(*lists).alias(c) for c, lists in ways.items()])


def similar_labels(tokens: DataFrame, lists: dict[str, DataFrame], ways: dict[str, tuple[str, str]], lex: Lexicons, words: DataFrame | None = None) -> DataFrame:
    """As ``exact_labels``, with similar names too, as ``mark_names`` judges them; ``ways`` name two of ``lists``. Each list is looked up once, however many ways use it."""
    used = {n: lists[n] for n in dict.fromkeys(n for two in ways.values() for n in two)}
    hits = gazetteer.lookup_lists(tokens if words is None else words, {f"_hit_{n}": names for n, names in used.items()}, [*lex.stop_first, *lex.stop_second])
    rows = gazetteer.with_hits(_keyed(tokens), hits, "_low")
    own = is_capitalised(F.col("text")) & (F.length("text") >= gazetteer.MIN_LENGTH)
    score = lambda n: F.coalesce(F.when((F.col(f"_hit_{n}.level") == "exact") | own, F.col(f"_hit_{n}.score")), F.lit(-1.0))
    stopped = stop_reason(F.col("text"), lex.stop_first or [""], lex.stop_second or [""], ("stop_first", "stop_second")).isNotNull()
    rows = rows.withColumns({f"_score_{n}": score(n) for n in used}).withColumn("_counts", F.when(F.greatest(*[F.col(f"_hit_{n}.score") for n in used], F.lit(-1.0)) >= 0, F.col("is_word") & ~stopped))
    label = lambda loc, per: F.when(F.col("_counts") & (F.greatest(f"_score_{loc}", f"_score_{per}") >= 0), F.when(F.col(f"_score_{loc}") >= F.col(f"_score_{per}"), "Location").otherwise("Person"))
    return rows.select(*tokens.columns, *[label(*two).alias(c) for c, two in ways.items()])


def name_lists(tokens: DataFrame, places: DataFrame, persons: DataFrame, lex: Lexicons, fuzzy: bool = True) -> DataFrame:
    """The word tokens of ``mark_names``."""
    return mark_names(tokens, places, persons, lex, fuzzy).where("is_word")


def name_list_summary(found: DataFrame) -> DataFrame:
    """Matches, stopped exact hits, by list, conflicts, by level."""
    c = F.col
    stopped = c("stop").isNotNull() & (F.coalesce("loc_exact", F.lit(False)) | F.coalesce("per_exact", F.lit(False)))
    return found.agg(
        F.count("label").alias("matches"), F.count_if(stopped).alias("stoplisted"), F.count_if(c("source") == "places").alias("places"), F.count_if(c("source") == "persons").alias("persons"),
        F.count_if("conflict").alias("conflicts"), F.count_if(c("level") == "exact").alias("exact"), F.count_if(c("level") == "fuzzy").alias("fuzzy"),
    )


def entity_matches(tokens: DataFrame, entities: DataFrame, skeleton_cutoff: float = 80.0, cutoff: float = 60.0) -> DataFrame:
    """Every match of a document's entities (``doc_id, ord, text, mapped_label``) with spans of its words.

    Spans have up to one word more than the entity, however long it is. Level 1: equal but for case (100);
    else level 2: consonants similar (entity with three or more); else level 3: similar.
    ``rank`` orders an entity's matches: level, equal numbers of words, score, shorter,
    earlier. Equal entities of a document are matched once.
    """
    own = entities.select("doc_id", F.col("text").alias("entity")).where("entity is not null").distinct()
    own = own.withColumn("words", F.size(F.split("entity", " +"))).withColumn("low", F.lower("entity")).withColumn("skel", consonant_skeleton(F.col("entity")))
    ours = F.collect_list(F.struct(*[c for c in own.columns if c != "doc_id"])).alias("ours")
    # lower case and consonants are those of single words, so spans needn't be made to have theirs
    words = tokens.withColumns({"low": F.lower("text"), "skel": consonant_skeleton(F.col("text"))})
    parts = tk.stretches_within(words, own.groupBy("doc_id").agg((F.max("words") + 1).alias("n"), ours), ["low", "skel"])
    parts = parts.select("doc_id", *[F.col(f"w.{c}").alias(c) for c in ("idx", "text", "low", "skel")], "ours")
    key = parts.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {key}, entity string, level int, score double, span_len int, start_idx int, ngram string, token_indices array<int>"
    found = parts.mapInArrow(matcher(tk.SPAN_WORDS, skeleton_cutoff, cutoff), kinds).join(own.select("doc_id", "entity", "words"), ["doc_id", "entity"])
    order = Window.partitionBy("doc_id", "entity").orderBy("level", (F.col("span_len") != F.col("words")).cast("int"), F.desc("score"), "span_len", "start_idx")
    return found.withColumn("rank", F.row_number().over(order)).select("doc_id", "entity", "rank", "level", "score", "span_len", "start_idx", "ngram", "token_indices")


def with_claims(rows: DataFrame, claims: DataFrame, name: str) -> DataFrame:
    """``rows`` with the label that ``project_entities`` gives their token, as ``name``. Claims of up to gazetteer.BROADCAST_HITS bytes go to the rows, which stay where they are."""
    claims = gazetteer.once(claims.select("doc_id", "idx", F.col("label").alias(name)))
    size = claims.agg(F.sum(F.octet_length(name) + F.lit(32))).first()[0] or 0
    return rows.join(F.broadcast(claims) if size <= gazetteer.BROADCAST_HITS else claims, ["doc_id", "idx"], "left")


def project_entities(tokens: DataFrame, entities: DataFrame, **options) -> DataFrame:
    """``doc_id, idx, label, ord, bio_position, level, score``: tokens claimed by each entity's best match; the first entity keeps a token."""
    best = entity_matches(tokens, entities, **options).where("rank = 1")
    named = entities.select("doc_id", "ord", F.col("text").alias("entity"), F.col("mapped_label").alias("label"))
    claims = named.join(best, ["doc_id", "entity"]).select("doc_id", "ord", "label", "level", "score", F.posexplode("token_indices").alias("pos", "idx"))
    first = claims.groupBy("doc_id", "idx").agg(F.min_by(F.struct("ord", "label", "pos", "level", "score"), "ord").alias("c"))
    return first.select("doc_id", "idx", "c.label", "c.ord", F.when(F.col("c.pos") == 0, "B").otherwise("I").alias("bio_position"), "c.level", "c.score")


def unmatched_entities(tokens: DataFrame, entities: DataFrame, **options) -> DataFrame:
    best = entity_matches(tokens, entities, **options).where("rank = 1").select("doc_id", F.col("entity").alias("text"))
    return entities.join(best, ["doc_id", "text"], "left_anti")


def top_matches(matches: DataFrame, n: int = 10) -> DataFrame:
    """``doc_id, entity, n_matches, best``: how many matches each entity has, and the first ``n`` by rank."""
    item = F.when(F.col("rank") <= n, F.struct("rank", "level", "score", "span_len", "start_idx", "ngram"))
    return matches.groupBy("doc_id", "entity").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list(item)).alias("best"))


def without_overlaps(matches: DataFrame) -> DataFrame:
    """Of each entity's matches, best first, those that share no token with a better one kept before; a fold over the ranked list."""
    kind = "array<struct<rank:int,token_indices:array<int>>>"
    listed = matches.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_list(F.struct("rank", "token_indices"))).alias("m"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        grown = F.struct(F.concat(acc["used"], m["token_indices"]).alias("used"), F.concat(acc["kept"], F.array(m)).alias("kept"))
        return F.when(F.arrays_overlap(acc["used"], m["token_indices"]), acc).otherwise(grown)

    kept = listed.select("doc_id", "entity", F.explode(F.aggregate("m", start, step, lambda a: a["kept"])).alias("k"))
    return matches.join(kept.select("doc_id", "entity", F.col("k.rank").alias("rank")), ["doc_id", "entity", "rank"], "left_semi")

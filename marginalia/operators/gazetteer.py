"""Name lists: building them from lines and rows, merging, and looking tokens up exactly or by similarity."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.arrays import let
from marginalia.functions.lexicon import is_capitalised, is_place_word
from marginalia.functions.similarity import bag, bag_may_reach, indel_ratio_of, match_bits, near_pairs
from marginalia.functions.text import split_words, strip

#: Defaults: least ratio, least token length, least share of the shorter length; words of an entry.
CUTOFF, MIN_LENGTH, MIN_SHARE, MAX_WORDS = 80.0, 4, 0.7, 4
#: A name list up to this many bytes is broadcast and met by length; a longer one is met by what names and words have in common.
BROADCAST_NAMES = 20_000
#: A table of names up to this many bytes goes to every task that looks words up; beyond it, words go to the names.
BROADCAST_TABLE = 8_000_000
#: The same for a table of the words of the texts that are like names.
BROADCAST_HITS = 32_000_000
#: Names that words meet by length are broadcast up to this many bytes, also out of a longer list.
BROADCAST_LONG = 1_000_000
#: Most keys that a word may have for that; words of lengths that would have more meet names by length, in blocks of this many bytes.
MOST_KEYS, BLOCK_NAMES = 1_000, 1_000_000
#: Words and names that meet in a task at once, and how many pairs of them may be looked at in all; beyond that they meet by letters.
CELL_WORDS, CELL_NAMES, MOST_PAIRS = 40_000, 40_000, 2_000_000_000_000


def places(lines: DataFrame, header: int = 32, admin_parts: list[str] | None = None, common: list[str] | None = None, admin: list[str] | None = None) -> DataFrame:
    """``name_lower, source_form`` from ``line_no`` (from 0), ``line``.

    One-word entries are names if they are place words, the last form of a name wins;
    each fit word of entries of 2 to 4 words (longer than 2, in neither list) is a name
    unless a one-word entry gives it, the first form wins; longer entries give none.
    """
    entry = lines.where(F.col("line_no") >= header).select("line_no", strip(F.col("line")).alias("entry")).where("entry <> ''")
    for part in admin_parts or []:
        entry = entry.where(~F.contains(F.lower("entry"), F.lit(part)))
    rows = entry.select("line_no", "entry", F.size(split_words(F.col("entry"))).alias("n"), F.posexplode(split_words(F.col("entry"))).alias("pos", "word"))
    low = F.lower("word")
    listed = low.isin(*(common or []), *(admin or [])) if (common or admin) else F.lit(False)
    fits = F.when(F.col("n") == 1, True).when(F.col("n") <= MAX_WORDS, (F.length("word") > 2) & ~listed).otherwise(False)
    names = rows.where(fits & is_place_word(F.col("word"))).select(low.alias("name_lower"), "entry", "line_no", "pos", (F.col("n") == 1).alias("single"))
    last = F.max_by(F.when(F.col("single"), F.col("entry")), F.when(F.col("single"), F.col("line_no")))
    first = F.min_by(F.when(~F.col("single"), F.col("entry")), F.when(~F.col("single"), F.struct("line_no", "pos")))
    # a word that a multi-word entry names first is overwritten by a later one-word entry, and kept out by an earlier one: either way the one-word form stays
    return names.groupBy("name_lower").agg(F.coalesce(last, first).alias("source_form"))


def place_statistics(lines: DataFrame, header: int = 32, admin_parts: list[str] | None = None, common: list[str] | None = None, admin: list[str] | None = None) -> DataFrame:
    """Entries by what became of them: raw, kept, filtered out (administrative), and the names that ``places`` makes of those kept."""
    entry = lines.where(F.col("line_no") >= header).select(F.lower(strip(F.col("line"))).alias("entry")).where("entry <> ''")
    out = F.lit(False)
    for part in admin_parts or []:
        out = out | F.contains(F.col("entry"), F.lit(part))
    counts = entry.agg(F.count("*").alias("raw"), F.count_if(~out).alias("kept"), F.count_if(out).alias("filtered_out"))
    names = places(lines, header, admin_parts, common, admin).agg(F.count("*").alias("unique_names"))
    return counts.join(F.broadcast(names))  # one row each


def simple(lines: DataFrame) -> DataFrame:
    """``name_lower, source_form``: stripped lines longer than one character, first form wins."""
    rows = lines.select("line_no", strip(F.col("line")).alias("entry")).where(F.length("entry") > 1)
    return rows.groupBy(F.lower("entry").alias("name_lower")).agg(F.min_by("entry", "line_no").alias("source_form"))


def clean_person(c: Column) -> Column:
    c = F.translate(strip(c), '±?()[]"', "")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^[* ]+", ""), r"^\.\.\.", ""), " +", " "))


def persons(rows: DataFrame) -> DataFrame:
    """``name_lower, source_form`` from ``row_no`` and ``fields`` (array): every comma-separated variant, cleaned; first form wins."""
    names = _variants(rows).where((F.length("name") > 1) & ~F.endswith("name", F.lit("-")))
    return names.groupBy(F.lower("name").alias("name_lower")).agg(F.min_by("name", F.struct("row_no", "field", "variant")).alias("source_form"))


def _variants(rows: DataFrame) -> DataFrame:
    cells = rows.select("row_no", F.posexplode("fields").alias("field", "cell"))
    return cells.select("row_no", "field", F.posexplode(F.split("cell", ",")).alias("variant", "raw")).select("row_no", "field", "variant", clean_person(F.col("raw")).alias("name"))


def person_statistics(rows: DataFrame) -> DataFrame:
    """Variants by what became of them: raw, empty, short, cut off, unique."""
    name = F.col("name")
    kept = (F.length(name) > 1) & ~F.endswith(name, F.lit("-"))
    return _variants(rows).agg(
        F.count("*").alias("raw"), F.count_if(name == "").alias("empty"), F.count_if(F.length(name) == 1).alias("short"),
        F.count_if((F.length(name) > 1) & F.endswith(name, F.lit("-"))).alias("cut_off"), F.count_distinct(F.when(kept, F.lower(name))).alias("unique_names"),
    )


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """``name_lower, source_form, is_new``: names of both, forms of ``first`` where it has them."""
    both = first.select("name_lower", "source_form", F.lit(0).alias("from")).unionByName(second.select("name_lower", "source_form", F.lit(1).alias("from")))
    return both.groupBy("name_lower").agg(F.min_by("source_form", "from").alias("source_form"), (F.min("from") == 1).alias("is_new"))


def derive_names(texts: DataFrame, text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """A list of the capitalised words of texts: ``name_lower, source_form``, least form in code-point order."""
    from marginalia.functions.text import is_word, tokens_in

    words = texts.select(F.explode(tokens_in(F.col(text))).alias("w"))
    words = words.where(is_word(F.col("w")) & is_capitalised(F.col("w")) & (F.length("w") >= least))
    return words.groupBy(F.lower("w").alias("name_lower")).agg(F.min("w").alias("source_form"))


def name_table(lists: dict[str, DataFrame]) -> DataFrame:
    """``name_lower`` and, for each of ``lists``, a column that says whether it has the name. One row a name."""
    every = None
    for kind, names in lists.items():
        rows = names.select("name_lower", F.lit(kind).alias("kind"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("name_lower").agg(*[F.max(F.col("kind") == k).alias(k) for k in lists])


def with_names(rows: DataFrame, table: DataFrame, word: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (``name_table``) for their ``word``, null where it isn't a name.

    The size of the table is asked first: a small one is broadcast, so the rows stay
    where they are.
    """
    size = table.agg(F.sum(F.octet_length("name_lower") + F.lit(16))).first()[0] or 0
    return rows.join(F.broadcast(table) if size <= BROADCAST_TABLE else table, F.col(word) == F.col("name_lower"), "left")


def with_hits(rows: DataFrame, hits: DataFrame, word: str) -> DataFrame:
    """``rows`` with the columns of ``hits`` (``lookup_lists``) for their ``word``, null where no list has it. A table of up to BROADCAST_HITS bytes goes to the rows."""
    hits = once(hits.withColumnRenamed("word_lower", word))
    kinds = [c for c in hits.columns if c != word]
    cost = F.octet_length(word) + F.lit(16)
    for c in kinds:
        cost = cost + F.coalesce(F.octet_length(f"{c}.name") + F.lit(40), F.lit(0))
    size = hits.agg(F.sum(cost)).first()[0] or 0
    return rows.join(F.broadcast(hits) if size <= BROADCAST_HITS else hits, word, "left")


def _needed(la: Column, lb: Column, cutoff: float) -> Column:
    """Letters that two strings of these lengths must have in common, in order, for the ratio to reach the cutoff."""
    return F.ceil(cutoff / 200.0 * (la + lb) - 1e-9).cast("int")


def _least_needed(n: int, cutoff: float) -> int:
    """The same with the shortest string that can reach it."""
    return math.ceil(cutoff / 200.0 * (n + math.ceil(n / (200.0 / cutoff - 1.0) - 1e-9)) - 1e-9)


def longest_keyed(cutoff: float, most: int | None = None) -> int:
    """The greatest length up to which a word has at most ``most`` subsequences that are long enough to be needed."""
    n = 1
    while n < 64 and sum(math.comb(n + 1, k) for k in range(_least_needed(n + 1, cutoff), n + 2)) <= (MOST_KEYS if most is None else most):
        n += 1
    return n


def _keys(word: Column, longest: int, cutoff: float, is_word: bool) -> Column:
    """A hash for each length that a partner may have and each way to take out so many letters of ``word`` that just those which the two need in common are left.

    Hashes have both lengths in them, so sides meet only where their lengths make these letters enough.
    """
    need = lambda n, m: math.ceil(cutoff / 200.0 * (n + m) - 1e-9)
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    def of(n: int) -> Column:
        partners: dict[int, list[int]] = {}
        for m in range(1, longest + 1):
            if need(n, m) <= min(n, m):
                partners.setdefault(n - need(n, m), []).append(m)

        def keys(level: Column, m: int) -> Column:
            return F.transform(level, lambda w: F.xxhash64(w, F.lit(n * 64 + m if is_word else m * 64 + n)))

        def grown(level: Column, k: int) -> Column:
            own = [keys(level, m) for m in partners.get(k, [])]
            if k == max(partners):
                return F.concat(*own)
            return F.concat(*own, let(F.array_distinct(F.flatten(F.transform(level, less))), lambda x: grown(x, k + 1)))

        return grown(F.array(word), 0)

    out = None
    for n in range(1, longest + 1):
        out = F.when(F.length(word) == n, of(n)) if out is None else out.when(F.length(word) == n, of(n))
    return out


def _pairs_by_letters(words: DataFrame, names: DataFrame, by: list[str], longest: int, cutoff: float) -> DataFrame:
    """Pairs (once each, with the name's ``bits``) of words and names up to a length that have as many letters in common, in order, as the cutoff needs: those letters and both lengths are the key, so hardly a row of the join is no such pair."""
    short = lambda df, c: df.where(F.length(c).between(1, longest))
    one = short(words, "word_lower").select("word_lower", F.explode(_keys(F.col("word_lower"), longest, cutoff, True)).alias("key"))
    other = short(names, "name_lower").select("name_lower", *by, F.explode(_keys(F.col("name_lower"), longest, cutoff, False)).alias("key"))
    met = one.join(other, "key")
    return met.select("word_lower", "name_lower", *by).distinct().withColumn("bits", match_bits(F.col("name_lower")))


def _pairs_by_length(words: DataFrame, names: DataFrame, by: list[str], cutoff: float, blocks: int) -> DataFrame:
    """Pairs, with the name's ``bits``, whose lengths and letters let them reach the cutoff; ``blocks`` 1: names are broadcast."""
    bound = 200.0 / cutoff - 1.0
    words = words.withColumn("bag", bag(F.col("word_lower")))
    words = words.withColumn("len", F.explode(F.sequence(F.ceil(F.length("word_lower") / bound - 1e-9), F.floor(F.length("word_lower") * bound + 1e-9))))
    names = names.select("name_lower", *by, match_bits(F.col("name_lower")).alias("bits"), bag(F.col("name_lower")).alias("name_bag"), F.length("name_lower").cast("long").alias("len"))
    if blocks <= 1:
        pairs = words.join(F.broadcast(names), "len")
    else:
        dealt = names.withColumn("block", F.pmod(F.xxhash64("name_lower"), F.lit(blocks)).cast("int"))
        pairs = words.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt.hint("merge"), ["len", "block"])
    return pairs.where(bag_may_reach(F.length("word_lower"), F.length("name_lower"), F.col("bag"), F.col("name_bag"), cutoff)).select("word_lower", "name_lower", *by, "bits")


def _near_in_cell(by: list[str], cutoff: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a task does with a cell: the best names of its words, of each kind, ties to the first."""

    def best(cell: pd.DataFrame) -> pd.DataFrame:
        words, names = cell.loc[~cell["is_name"], "text"], cell[cell["is_name"]]
        texts, listed = words.tolist(), names["text"].tolist()
        found = [np.concatenate(x) for x in zip(*near_pairs(texts, listed, cutoff), strict=True)] if texts and listed else []
        at, to, score = found or ([], [], [])
        out = pd.DataFrame({"word_lower": words.to_numpy()[np.asarray(at, int)], "name_lower": names["text"].to_numpy()[np.asarray(to, int)], "score": np.asarray(score, float)})
        for c in by:
            out[c] = names[c].to_numpy()[np.asarray(to, int)]
        return out.sort_values(["score", "name_lower"], ascending=[False, True]).drop_duplicates(["word_lower", *by])

    return best


def _near_by_cells(words: DataFrame, names: DataFrame, by: list[str], cutoff: float, n_words: int, n_names: int) -> DataFrame:
    """``word_lower, by, name_lower, score``: the best names of each word from ``cutoff`` on in each block of names. Blocks of words and of names meet in cells, which are dealt out, so a task holds two blocks whatever the lists."""
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    across = max(1, -(-n_names // CELL_NAMES))
    down = max(-(-n_words // CELL_WORDS), min(-(-3 * tasks // across), -(-n_words // 100)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = [F.lit(None).cast(names.schema[c].dataType).alias(c) for c in by]
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    one = words.where("word_lower is not null").select(block("word_lower", down).alias("row"), every(across).alias("column"), F.lit(False).alias("is_name"), F.col("word_lower").alias("text"), *none)
    other = names.where("name_lower is not null").select(every(down).alias("row"), block("name_lower", across).alias("column"), F.lit(True).alias("is_name"), F.col("name_lower").alias("text"), *by)
    kind = "".join(f", {c} {names.schema[c].dataType.simpleString()}" for c in by)
    met = one.unionByName(other).repartition(max(tasks, down * across), "row", "column")
    return met.groupBy("row", "column").applyInPandas(_near_in_cell(by, cutoff), f"word_lower string, name_lower string, score double{kind}")


def once(rows: DataFrame) -> DataFrame:
    """A table that is small beside the texts it comes from and is used several times: worked out once, in the folder for checkpoints if there is one."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def _pairs_of_long_lists(words: DataFrame, names: DataFrame, by: list[str], cutoff: float, size: int) -> DataFrame:
    """Pairs of lists of any length, with the name's ``bits``: by letters, and by length where a word would have too many keys."""
    longest = longest_keyed(cutoff)
    # one side may be short where the other is long, as far as lengths can reach the cutoff
    reach = F.lit(longest) / (200.0 / cutoff - 1.0)
    lw, ln = F.length("word_lower"), F.length("name_lower")
    long = names.where(ln > longest)
    sizes = names.agg(*[F.sum(F.when(ln > least, F.octet_length("name_lower"))) for least in (reach, F.lit(longest))]).first()
    blocks = [1 if (n or 0) <= BROADCAST_LONG else max(2, -(-size // BLOCK_NAMES)) for n in sizes]
    far = _pairs_by_length(words.where(lw > longest), names.where(ln > reach), by, cutoff, blocks[0])
    far = far.unionByName(_pairs_by_length(words.where((lw > reach) & (lw <= longest)), long, by, cutoff, blocks[1]))
    return _pairs_by_letters(words, names, by, longest, cutoff).unionByName(far)


def best_similar(names: DataFrame, words: DataFrame, cutoff: float = CUTOFF, kind: str | None = None) -> DataFrame:
    """``word_lower, name_lower, score``: for each distinct lower-cased word the most similar name from ``cutoff`` on, ties to the first in code-point order.

    With ``kind``, a column of ``names``, the most similar name of each kind, and that
    column. A short list of names is broadcast and met by length, with bags of letters to
    rule pairs out. With a longer one, blocks of words and of names meet in tasks, which
    rule pairs out in the same way. Beyond MOST_PAIRS, words and names meet in the
    letters that they must have in common, in order, to reach the cutoff: no such pair
    is missed, and others hardly meet. Words too long for that many keys (over 12
    letters at a cutoff of 80) meet by length, dealt out in blocks of names.
    """
    by = [kind] if kind else []
    spark = words.sparkSession
    # few bytes and much work: dealt over all cores, which the size of the words alone wouldn't call for
    words = once(words.select("word_lower").distinct().repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    names = once(names.select("name_lower", *by))
    size, n_names = names.agg(F.coalesce(F.sum(F.octet_length("name_lower")), F.lit(0)), F.count("*")).first()
    n_words = words.count() if size > BROADCAST_NAMES else 0
    if size > BROADCAST_NAMES and n_words * n_names <= MOST_PAIRS:
        scored = _near_by_cells(words, names, by, cutoff, n_words, n_names)
    else:
        pairs = _pairs_by_length(words, names, by, cutoff, 1) if size <= BROADCAST_NAMES else _pairs_of_long_lists(words, names, by, cutoff, size)
        scored = pairs.select("word_lower", *by, "name_lower", indel_ratio_of(F.col("name_lower"), F.col("bits"), F.col("word_lower")).alias("score")).where(F.col("score") >= cutoff)
    best = scored.groupBy("word_lower", *by).agg(F.min(F.struct((-F.col("score")).alias("s"), "name_lower")).alias("b"))
    return best.select("word_lower", *by, F.col("b.name_lower").alias("name_lower"), (-F.col("b.s")).alias("score"))


def lookup_lists(tokens: DataFrame, lists: dict[str, DataFrame], blocked: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """``word_lower`` and, for each of ``lists``, a struct of score, level and name (null for none), for the distinct words of ``tokens`` (``doc_id, idx, text, is_word``) that a list has.

    Exact hits count whatever the case of the word. Words that stand capitalised
    somewhere and have four letters are compared with all names; the best name is then
    dropped if it is blocked or much longer or shorter, and no other takes its place.
    Matching doesn't depend on the context, so it runs on distinct words, and on all
    lists at once.
    """
    words = once(tokens.where("is_word").groupBy(F.lower("text").alias("word_lower")).agg(F.max(is_capitalised(F.col("text")) & (F.length("text") >= MIN_LENGTH)).alias("capital")))
    every = None
    for kind, names in lists.items():
        rows = names.select("name_lower", F.lit(kind).alias("kind"))
        every = rows if every is None else every.unionByName(rows)
    every = once(every)
    hit = lambda score, level, name: F.struct(score.alias("score"), F.lit(level).alias("level"), name.alias("name"))
    exact = words.join(every, F.col("word_lower") == F.col("name_lower")).select("word_lower", "kind", hit(F.lit(100.0), "exact", F.col("word_lower")).alias("hit"))
    found = best_similar(every, words.where("capital"), cutoff, "kind").where("word_lower <> name_lower")
    la, lb = F.length("word_lower"), F.length("name_lower")
    found = found.where((F.least(la, lb) / F.greatest(la, lb) >= MIN_SHARE) & (~F.col("name_lower").isin(*blocked) if blocked else F.lit(True)))
    both = exact.unionByName(found.select("word_lower", "kind", hit(F.col("score"), "fuzzy", F.col("name_lower")).alias("hit")))
    return both.groupBy("word_lower").agg(*[F.max(F.when(F.col("kind") == k, F.col("hit"))).alias(k) for k in lists])


def lookup(tokens: DataFrame, names: DataFrame, blocked: list[str], fuzzy: bool = True, cutoff: float = CUTOFF) -> DataFrame:
    """``word_lower, score, level, name`` for the distinct words of ``tokens`` that one list has, as ``lookup_lists`` finds them; without ``fuzzy`` exact names only."""
    if fuzzy:
        return lookup_lists(tokens, {"hit": names}, blocked, cutoff).select("word_lower", "hit.*")
    words = tokens.where("is_word").select(F.lower("text").alias("word_lower")).distinct()
    return words.join(names.select(F.col("name_lower").alias("word_lower")), "word_lower").select("word_lower", F.lit(100.0).alias("score"), F.lit("exact").alias("level"), F.col("word_lower").alias("name"))

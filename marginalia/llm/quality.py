"""Quality rules: a cascade of tests, ordered by what they reject for their cost.

Native: every feature and rule is a Catalyst expression over one row; no shuffle. On a
sample each rule is run by itself between two readings of the clock, and the order is
built up from there: next comes the rule that rejects most, for its time, of the rows
that the rules before it leave.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, let, words_of

#: Fixed values of the base test.
MIN_WORDS, REPEATED_SHARE, WINDOW = 50, 50, 3
SYMBOLS = "[#*$%&|<>]"


def _lines_with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)


def _repeat_words(words: Column) -> Column:
    """Positions inside 3-word windows that occur twice or more, the first occurrence included.

    The windows are sorted with their positions, so equal ones are neighbours; then
    the covered stretches are added up in position order. n log n in the words.
    """

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(order: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        sort = lambda h: let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), sort(h)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(words) > WINDOW, let(words, windows)).otherwise(F.lit(0).cast("long"))


def _cheap(t: Column, w: Column) -> list[Column]:
    return [
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(_lines_with_word(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def cheap_features(text: Column) -> Column:
    """A struct of the base counts of a text, but for repeated words; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return let(words_of(t), lambda w: F.struct(*_cheap(t, w)))


def base_features(text: Column) -> Column:
    """A struct of the base counts of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return let(words_of(t), lambda w: F.struct(*_cheap(t, w), _repeat_words(w).alias("n_repeat_words")))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > REPEATED_SHARE * f["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects``: of text, cheap features and number of repeated words, true for a text to refuse; never null.

    The number of repeated words takes long to work out, and is so only where a rule
    names it.
    """

    name: str
    rejects: Callable[[Column, Column, Column], Column]


def _count(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


#: Wide of ordinary prose in any language written with letters; each catches a kind of junk. The first two are the base test.
RULES = (
    Rule("few_words", lambda t, f, n: f["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda t, f, n: 100 * n > REPEATED_SHARE * f["n_words"]),
    Rule("word_length", lambda t, f, n: (f["word_chars"] > 30 * f["n_words"]) | (10 * f["word_chars"] < 20 * f["n_words"])),
    Rule("symbols", lambda t, f, n: 4 * f["n_symbols"] > f["n_words"]),
    Rule("duplicate_lines", lambda t, f, n: 2 * f["n_dup_lines"] > F.size(F.split(t, "\n", -1))),
    Rule("shouting", lambda t, f, n: 2 * _count(t, r"\p{Lu}") > _count(t, r"\p{L}")),
    Rule("exclamations", lambda t, f, n: 3 * _count(t, "!") > f["n_words"]),
    Rule("letters", lambda t, f, n: 2 * _count(t, r"[\p{L}\p{M}]") < f["word_chars"]),
)
#: Rows of the sample at most, and one in how many rows (by a hash of the text) it is taken from.
SAMPLE_ROWS, SAMPLE_EVERY = 400, 8


def measured(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[list[tuple[int, bool]]]:
    """For rows of a sample, each rule's nanoseconds and whether it rejects the text.

    Rows are drawn by a hash of their text until there are enough, so only a part of a
    large table is read. The cheap features are worked out before the first reading.
    """
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    t = F.coalesce(F.col(text), F.lit(""))

    def verdict(r: Rule) -> Callable[[Column], Column]:
        return lambda x: r.rejects(x["t"], x["f"], let(words_of(x["t"]), _repeat_words))

    def timed(x: Column) -> Column:
        columns = [clock().alias("c0")]
        for i, r in enumerate(rules):
            columns += [let(x, verdict(r)).alias(f"r{i}"), clock().alias(f"c{i + 1}")]
        return F.struct(*columns)

    drawn = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(SAMPLE_EVERY)) == 0).select(F.struct(t.alias("t"), cheap_features(F.col(text)).alias("f")).alias("x"))
    rows = drawn.select(timed(F.col("x")).alias("m")).take(sample_rows)
    return [[(m[f"c{i + 1}"] - m[f"c{i}"], m[f"r{i}"]) for i in range(len(rules))] for (m,) in rows]


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in order of rejections per cost, both from a sample: the cost is the median time, the rejections are among the rows that the rules before leave.

    The order decides only how soon a text is refused, never whether. Rules that reject
    nothing more come last, the cheapest first; an empty sample keeps the given order.
    """
    rows = measured(docs, text, rules, sample_rows)
    if not rows:
        return list(rules)
    cost = [max(1, sorted(r[i][0] for r in rows)[len(rows) // 2]) for i in range(len(rules))]
    order: list[int] = []
    left = rows
    while len(order) < len(rules):
        hits = {i: sum(r[i][1] for r in left) for i in range(len(rules)) if i not in order}
        best = min(hits, key=lambda i: (-hits[i] / cost[i], cost[i], i))
        order.append(best)
        left = [r for r in left if not r[best][1]]
    return [rules[i] for i in order]


def _first_refusal(rules: list[Rule], t: Column, f: Column, repeats: Column) -> Column:
    first = F
    for r in rules:
        first = first.when(r.rejects(t, f, repeats), F.lit(r.name))
    return F.lit(None).cast("string") if first is F else first


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | list[Rule] | None = None, into: str = "verdict") -> DataFrame:
    """``docs`` with a struct column ``into``: the base counts, base_failed, rule and kept.

    ``rule`` names the first rule of the cascade that refuses the text, null if none
    does; later rules aren't evaluated then (the base counts always are). An ``into``
    that ``docs`` has already is replaced. Null and empty texts have no words, and fail
    the base test. Repeated rows get equal verdicts; an empty table stays empty.
    """
    rules = plan_cascade(docs, text) if rules is None else rules
    t, f = F.coalesce(F.col(text), F.lit("")), fresh(docs, "_features")
    made = docs.withColumn(f, base_features(F.col(text)))
    g = fresh(made, "_rule")
    made = made.withColumn(g, _first_refusal(rules, t, F.col(f), F.col(f)["n_repeat_words"]))
    bad = base_failed(F.col(f))
    verdict = F.struct(*[F.col(f)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], bad.alias("base_failed"), F.col(g).alias("rule"), (~bad & F.col(g).isNull()).alias("kept"))
    return made.withColumn(into, verdict).drop(f, g)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text no rule refuses, with the columns they had.

    A text that a rule refuses isn't looked at by later ones, so its repeated words may
    never be counted. Null and empty texts go; repeated rows are all kept or all gone;
    an empty table stays empty.
    """
    rules = plan_cascade(docs, text) if rules is None else rules
    t, f = F.coalesce(F.col(text), F.lit("")), fresh(docs, "_features")
    made = docs.withColumn(f, cheap_features(F.col(text)))
    g = fresh(made, "_rule")
    repeats = let(words_of(t), _repeat_words)
    return made.withColumn(g, _first_refusal(rules, t, F.col(f), repeats)).where(F.col(g).isNull()).drop(f, g)

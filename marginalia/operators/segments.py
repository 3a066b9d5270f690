"""Sequences of any length in segments, so that no task gets a whole document.

What a row needs from before its segment is either the last value of some kind
(``carried``, ``greatest_before``) or the state that a small automaton has reached (``entry_states``). For
the first, each segment hands on its own last value; for the second, each becomes a
function from state to state, and functions compose, whatever the state at the start
is. Only these summaries, one row a segment, are put in order by sequence; the rows of
a segment stay where they are, so one exchange by segment serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marginalia.functions.arrays import let, running

#: A row's segment: the keys of its sequence and ``n``, the number of the segment.
SEGMENT = "_segment"


def segmented(rows: DataFrame, size: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` with their segment, ``size`` places of ``idx`` each, unless they have one for these keys."""
    if SEGMENT in rows.columns and rows.schema[SEGMENT].dataType.names == [*keys, "n"]:
        return rows
    return rows.withColumn(SEGMENT, F.struct(*keys, F.floor(F.col("idx") / size).alias("n")))


def in_order(keys: tuple[str, ...], way=F.asc) -> WindowSpec:
    """The summaries of a sequence's segments."""
    return Window.partitionBy(*[F.col(f"{SEGMENT}.{k}") for k in keys]).orderBy(way(f"{SEGMENT}.n"))


def past(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, before: dict[str, Column], after: dict[str, Column] | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` (of ``segmented``) with, for each of ``before``, the last value that isn't null of the rows before, and for each of ``after`` the first one of those that follow."""
    after = after or {}
    rows = rows.withColumns({f"_v_{n}": v for n, v in (before | after).items()})
    at = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col("idx"))
    own = [F.max_by(f"_v_{n}", at(n)).alias(n) for n in before] + [F.min_by(f"_v_{n}", at(n)).alias(n) for n in after]
    last = lambda c, w: F.last(c, ignorenulls=True).over(past(w))
    ways = [*((n, F.asc) for n in before), *((n, F.desc) for n in after)]
    summaries = rows.groupBy(SEGMENT).agg(*own).select(SEGMENT, *[last(n, in_order(keys, way)).alias(f"_c_{n}") for n, way in ways])
    rows = rows.join(summaries, SEGMENT, "left")
    rows = rows.withColumns({n: F.coalesce(last(f"_v_{n}", Window.partitionBy(SEGMENT).orderBy(way("idx"))), F.col(f"_c_{n}")) for n, way in ways})
    return rows.drop(*[f"_{x}_{n}" for n, _ in ways for x in "vc"])


def greatest_before(rows: DataFrame, of: dict[str, Column], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` (of ``segmented``) with, for each of ``of``, the greatest value of the rows before: where values grow with ``idx``, the last one. As ``carried``, for numbers, which need neither structs nor a sort for their summaries."""
    most = lambda c, w: F.max(c).over(past(w))
    rows = rows.withColumns({f"_v_{n}": v for n, v in of.items()})
    summaries = rows.groupBy(SEGMENT).agg(*[F.max(f"_v_{n}").alias(n) for n in of]).select(SEGMENT, *[most(n, in_order(keys)).alias(f"_c_{n}") for n in of])
    rows = rows.join(summaries, SEGMENT, "left")
    rows = rows.withColumns({n: F.greatest(most(f"_v_{n}", Window.partitionBy(SEGMENT).orderBy("idx")), F.col(f"_c_{n}")) for n in of})
    return rows.drop(*[f"_{x}_{n}" for n in of for x in "vc"])


def function(to: list[int]) -> int:
    """A function from states (0, 1, ...) to states, as a number with a digit a state."""
    return sum(t * len(to) ** s for s, t in enumerate(to))


def image(f: Column, state: Column, states: int) -> Column:
    """The state that a function leads to."""
    power = F.get(F.array(*[F.lit(states**s) for s in range(states)]), state)
    return F.pmod(F.floor(f / power).cast("int"), F.lit(states))


def then(f: Column, g: Column, states: int) -> Column:
    """The function that does ``f``, then ``g``."""
    total = F.lit(0)
    for s in range(states):
        total = total + image(g, image(f, F.lit(s), states), states) * states**s
    return total.cast("int")


def entry_states(rows: DataFrame, does: Column, states: int, start: int = 0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` (of ``segmented``) with ``entry``, the state in which their segment begins; ``does`` is each row's ``function``."""
    same = function(list(range(states)))
    step = lambda f, g: then(f, g, states)
    parts = rows.groupBy(SEGMENT).agg(F.sort_array(F.collect_list(F.struct("idx", does.alias("f")))).alias("t"))
    parts = parts.select(SEGMENT, F.aggregate(F.transform("t", lambda x: x["f"]), F.lit(same), step).alias("f"))
    key = [F.col(f"{SEGMENT}.{k}").alias(f"_key_{i}") for i, k in enumerate(keys)]
    lists = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(f"{SEGMENT}.n").alias("n"), SEGMENT, "f"))).alias("t"))
    reached = lambda every: F.transform("t", lambda x, i: F.struct(x[SEGMENT].alias(SEGMENT), image(F.coalesce(F.get(every, i - 1), F.lit(same)), F.lit(start), states).alias("entry")))
    entries = lists.select(F.explode(let(running(F.transform("t", lambda x: x["f"]), step, same), reached)).alias("e")).select("e.*")
    return rows.join(entries, SEGMENT, "left")

"""Running totals over an array within a row, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], first: int = 0, some: int = 256, kind: str = "int") -> Column:
    """The values of an array of ``kind`` taken together from the left, up to and including each.

    In stretches of ``some`` values, then over the stretches, so that growing an array
    value by value doesn't take time with the square of its length. ``step`` has to be
    associative, with ``first`` as its neutral value.
    """
    none = F.array().cast(f"array<{kind}>")

    def scan(a: Column, start: Column) -> Column:
        return F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), start), x))))

    def of(parts: Column) -> Column:
        whole = scan(F.transform(parts, lambda a: F.aggregate(a, F.lit(first).cast(kind), step)), F.lit(first).cast(kind))
        return let(whole, lambda w: F.flatten(F.transform(parts, lambda a, i: scan(a, F.coalesce(F.get(w, i - 1), F.lit(first).cast(kind))))))

    stretches = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / some).cast("int")), lambda i: F.slice(v, i * some + 1, some))
    return let(values, lambda v: F.when(F.size(v) > 0, let(stretches(v), of)).otherwise(none))

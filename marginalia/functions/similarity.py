"""Indel similarity (twice the longest common subsequence over both lengths) as built-in expressions and, where many pairs meet, over blocks of pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import let

#: Longest string whose positions fit a long; a pair with the shorter one above takes several longs.
WIDEST = 62


def _lcs(short: Column, long: Column) -> Column:
    """Bit-parallel: each character of ``long`` updates a row of match bits over ``short``."""

    def over(chars: Column) -> Column:
        full = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(chars)) - 1
        places = lambda c: F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), F.lit(0).cast("long"), lambda acc, k: F.when(F.get(chars, k) == c, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(acc))
        masks = F.transform(F.filter(F.split(long, ""), lambda c: c != ""), places)
        step = lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(full)
        return F.size(chars) - F.bit_count(F.aggregate(masks, full, step))

    return let(F.filter(F.split(short, ""), lambda c: c != ""), over)


def _wide_lcs(short: Column, long: Column) -> Column:
    """The same with the match bits in several longs of WIDEST bits each; sums carry over, and bits beyond ``short`` never match."""
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, F.lit(WIDEST)) - 1

    def over(chars: Column) -> Column:
        limbs = F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / WIDEST).cast("int"))
        bit = lambda c: lambda acc, k: F.when(F.get(chars, k) == c, acc.bitwiseOR(F.call_function("shiftleft", one, k % WIDEST))).otherwise(acc)
        places = lambda c: F.transform(limbs, lambda g: F.aggregate(F.sequence(g * WIDEST, F.least(g * WIDEST + WIDEST, F.size(chars)) - 1), F.lit(0).cast("long"), bit(c)))
        masks = F.transform(F.filter(F.split(long, ""), lambda c: c != ""), places)
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("v"))

        def step(v: Column, m: Column) -> Column:
            def limb(acc: Column, g: Column) -> Column:
                x = F.get(v, g)
                hit = x.bitwiseAND(F.get(m, g))
                total = x + hit + acc["carry"]
                new = total.bitwiseOR(x - hit).bitwiseAND(full)
                return F.struct(F.call_function("shiftright", total, F.lit(WIDEST)).alias("carry"), F.concat(acc["v"], F.array(new)).alias("v"))

            return F.aggregate(limbs, start, limb, lambda acc: acc["v"])

        left = F.aggregate(masks, F.transform(limbs, lambda g: full), step)
        return F.aggregate(left, F.lit(0), lambda acc, x: acc + WIDEST - F.bit_count(x))

    return let(F.filter(F.split(short, ""), lambda c: c != ""), over)


def indel_ratio(a: Column, b: Column, widest: int = WIDEST) -> Column:
    """0 to 100; 100 if both are empty, null for a null. Exact at every length: pairs whose shorter string is over ``widest`` take several longs."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    total = F.length(a) + F.length(b)
    narrow = F.when(F.length(short) <= widest, 200.0 * _lcs(short, long) / total)
    wide = F.when(F.length(short) > widest, 200.0 * _wide_lcs(short, long) / total)
    return F.when(total == 0, 100.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(F.coalesce(narrow, wide))


def match_bits(word: Column, widest: int = WIDEST) -> Column:
    """What ``indel_ratio_of`` needs of a word: its length, and for each character a long with the bits of its places; null over ``widest``."""

    def of(chars: Column) -> Column:
        zero = F.lit(0).cast("long")
        bit = lambda c: lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)
        places = lambda c: F.aggregate(F.transform(chars, bit(c)), zero, lambda acc, x: acc.bitwiseOR(x))
        distinct = F.array_distinct(chars)
        return F.struct(F.size(chars).alias("n"), F.map_from_arrays(distinct, F.transform(distinct, places)).alias("at"))

    return F.when(F.length(word) <= widest, let(F.filter(F.split(word, ""), lambda c: c != ""), of))


def indel_ratio_of(a: Column, bits: Column, b: Column) -> Column:
    """``indel_ratio`` of ``a``, whose ``match_bits`` are known, and ``b``: a step a character of ``b``."""
    zero, total = F.lit(0).cast("long"), F.length(a) + F.length(b)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), bits["n"]) - 1
    masks = F.transform(F.filter(F.split(b, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(bits["at"], c), zero))
    row = F.aggregate(masks, full, lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(full))
    near = F.when(total == 0, 100.0).otherwise(200.0 * (bits["n"] - F.bit_count(row)) / total)
    return F.when(bits.isNotNull(), near).otherwise(indel_ratio(a, b))


#: Bits of a bag of letters, in two longs.
BAG = 124


def bag(word: Column) -> Column:
    """A struct of two longs with a bit for each character and how many of it came before (the first a, the second a), by a hash of both.

    Never null (a null word has no letters): Spark asks of what a join compares whether
    it is null, and would work the bags out for that alone, long before the join.
    """
    none = F.lit(0).cast("long")

    def of(chars: Column) -> Column:
        times = lambda c: F.greatest(F.length(word) - F.length(F.replace(word, c, F.lit(""))), F.lit(1))
        places = F.flatten(F.transform(F.array_distinct(chars), lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda k: (F.ascii(c) * 37 + k * 29) % BAG)))
        half = lambda at, low: F.aggregate(F.filter(at, lambda p: (p >= low) & (p < low + BAG // 2)), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - low)))
        return let(places, lambda at: F.struct(F.coalesce(half(at, 0), none).alias("a"), F.coalesce(half(at, BAG // 2), none).alias("b")))

    return F.coalesce(let(F.filter(F.split(word, ""), lambda c: c != ""), of), F.struct(none.alias("a"), none.alias("b")))


def bag_may_reach(la: Column, lb: Column, bag_a: Column, bag_b: Column, ratio: float) -> Column:
    """False only if the Indel ratio of words of these lengths can't reach ``ratio``: by lengths, and by letters, counted, that only one side has.

    Letters that share a bit only make the sides look more alike.
    """
    apart = F.bit_count(bag_a["a"].bitwiseXOR(bag_b["a"])) + F.bit_count(bag_a["b"].bitwiseXOR(bag_b["b"]))
    return (200.0 * F.least(la, lb) >= ratio * (la + lb) - 1e-9) & ((la + lb - apart) * 100.0 >= ratio * (la + lb) - 1e-9)


#: Longest string that blocks of pairs hold as a row of a matrix; pairs with a longer one are worked out one by one. Pairs that are compared at once.
BLOCK_WIDEST, BLOCK = 128, 16_384


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each word, filled up with zeros to a multiple of eight, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = max(8, -(-int(sizes.max(initial=1)) // 8) * 8)
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width), sizes


def _lcs_of_rows(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Bit-parallel as ``_lcs``, for all rows at once; ``a`` has at most WIDEST letters."""
    a = a[:, :64]
    full = (np.uint64(1) << n_a.astype(np.uint64)) - np.uint64(1)
    row, bits = full.copy(), np.zeros((len(a), 8), np.uint8)
    for j in range(int(n_b.max(initial=0))):
        bits[:, : a.shape[1] // 8] = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little")
        hit = row & np.where(j < n_b, bits.view("<u8")[:, 0], np.uint64(0))
        row = ((row + hit) | (row - hit)) & full
    return n_a - np.bitwise_count(row)


def _lcs_of_two(a: str, b: str) -> int:
    """The same for strings of any length, with whole numbers of any size."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``indel_ratio`` of each of ``a`` with its partner in ``b``."""
    out = np.empty(len(a))
    for i in range(0, len(a), BLOCK):
        pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a[i : i + BLOCK], b[i : i + BLOCK], strict=True)]
        wide = [k for k, (x, y) in enumerate(pairs) if len(x) > WIDEST or len(y) > BLOCK_WIDEST]
        found = {k: _lcs_of_two(*pairs[k]) for k in wide}
        for k in wide:
            pairs[k] = (pairs[k][0][:1], pairs[k][1][:1])
        total = np.array([len(x) + len(y) for x, y in zip(a[i : i + BLOCK], b[i : i + BLOCK], strict=True)], np.int64)
        (x, n_x), (y, n_y) = code_points([p[0] for p in pairs]), code_points([p[1] for p in pairs])
        same = _lcs_of_rows(x, n_x, y, n_y).astype(np.int64)
        for k, v in found.items():
            same[k] = v
        out[i : i + BLOCK] = np.where(total == 0, 100.0, 200.0 * same / np.maximum(total, 1))
    return out


def _known_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([None] * len(a), dtype="Float64")
    out[known] = ratios(a[known].tolist(), b[known].tolist())
    return out


def indel_ratio_in_blocks(a: Column, b: Column) -> Column:
    """``indel_ratio`` for many pairs; null where either is."""
    return F.pandas_udf(_known_ratios, "double")(a, b)


def _bags(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``bag`` of each row, in two longs of 64 bits."""
    out = np.zeros((len(rows), 2), np.uint64)
    for i in range(int(sizes.max(initial=0))):
        nth = (rows[:, : i + 1] == rows[:, i : i + 1]).sum(axis=1)
        place = (rows[:, i].astype(np.int64) * 37 + nth * 29) % 128
        bit = np.where(i < sizes, np.uint64(1) << (place % 64).astype(np.uint64), np.uint64(0))
        for half in (0, 1):
            out[:, half] |= np.where(place // 64 == half, bit, np.uint64(0))
    return out


#: Pairs of bags that are held against each other at once.
AT_ONCE = 131_072
#: Pairs of bags that take the time of one key; keys that are held at once.
KEY_COST, KEYS_AT_ONCE = 4, 1_000_000
#: Two odd numbers, for sums that tell strings apart and for the place of such a sum in a table.
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=256)
def _kept(n: int, k: int) -> np.ndarray:
    """Every way to keep ``k`` of ``n`` places, in order."""
    return np.array(list(itertools.combinations(range(n), k)), np.intp).reshape(-1, k)


def _subsequences(rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """A number for each way (a row) to keep ``k`` letters of each of ``rows`` (a column), strings of ``n`` letters; equal letters give equal numbers."""
    kept, letters = _kept(n, k), np.ascontiguousarray(rows[:, :n].T, dtype=np.uint64) + np.uint64(1)
    out = np.zeros((len(kept), len(rows)), np.uint64)
    for j in range(k):
        out *= _STEP
        out += letters[kept[:, j]]
    return out


def _keyed_names(rows: np.ndarray, names: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_subsequences`` of names in order, whose they are, and a table that says which may be among them; some names at a time."""
    out, step = [], max(1, KEYS_AT_ONCE // math.comb(n, k))
    for i in range(0, len(names), step):
        some = names[i : i + step]
        keys = _subsequences(rows[some], n, k).ravel()
        order = np.argsort(keys)
        bits = max(10, int(8 * len(keys)).bit_length())
        table = np.zeros(1 << bits, bool)
        table[(keys * _SPREAD) >> np.uint64(64 - bits)] = True
        out.append((keys[order], some[order % len(some)], table))
    return out


def _met_by_letters(rows: np.ndarray, words: np.ndarray, n: int, k: int, keyed: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_names: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of ``n`` letters and of names that have ``k`` letters in common, in order, once each."""
    step = max(1, KEYS_AT_ONCE // math.comb(n, k))
    for i in range(0, len(words), step):
        some = words[i : i + step]
        keys = _subsequences(rows[some], n, k).ravel()
        spread = keys * _SPREAD
        for listed, whose, table in keyed:
            may = np.flatnonzero(table[spread >> np.uint64(65 - len(table).bit_length())])
            first, last = (np.searchsorted(listed, keys[may], side) for side in ("left", "right"))
            total = np.cumsum(last - first)
            at, every = 0, [np.empty(0, np.int64)]
            while at < len(may):  # a few letters may be common to very many
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + KEYS_AT_ONCE, "right")))
                times = (last - first)[at:to]
                place = np.arange(times.sum()) + np.repeat(first[at:to] - (np.cumsum(times) - times), times)
                every.append(np.unique(some[np.repeat(may[at:to], times) % len(some)] * n_names + whose[place]))
                at = to
            yield np.divmod(np.unique(np.concatenate(every)) if len(every) > 2 else every[-1], n_names)


def _met_by_bags(words: np.ndarray, bag_w: np.ndarray, names: np.ndarray, bag_n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of all pairs whose bags of letters differ in at most ``most``."""
    step = max(1, AT_ONCE // len(names))
    bag_n = np.ascontiguousarray(bag_n.T)
    for i in range(0, len(words), step):
        apart = sum(np.bitwise_count(bag_w[i : i + step, half : half + 1] ^ bag_n[half]) for half in (0, 1))
        at, to = np.divmod(np.flatnonzero(apart <= most), len(names))
        yield words[i + at], names[to]


def near_pairs(words: list[str], names: list[str], cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``words`` and in ``names`` of the pairs whose ratio reaches ``cutoff``, with the ratio; a few at a time.

    For each two lengths it is known how many letters a pair must have in common, in
    order. Words and names meet in those letters, which grows with both but not with
    their pairs, or, where there are more ways to keep so many letters than pairs, all
    pairs are ruled out by bags of letters, as in ``bag_may_reach``.
    """
    (w, n_w), (n, n_n) = code_points(words), code_points(names)
    of = lambda sizes: {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes) if size > 0}
    own, other, keyed, bags = of(n_w), of(n_n), {}, {}
    left, waiting = [], 0

    def compared() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, to = (np.concatenate(x) for x in zip(*left, strict=True))
        score = ratios([words[k] for k in at], [names[k] for k in to])
        near = score >= cutoff
        return at[near], to[near], score[near]

    for size, some in own.items():
        bag_w = None
        for length, those in other.items():
            total = size + length
            if 200.0 * min(size, length) < cutoff * total - 1e-9:
                continue
            need = math.ceil(cutoff * total / 200.0 - 1e-9)
            if KEY_COST * (len(some) * math.comb(size, need) + len(those) * math.comb(length, need)) < len(some) * len(those):
                if (length, need) not in keyed:
                    keyed[length, need] = _keyed_names(n, those, length, need)
                met = _met_by_letters(w, some, size, need, keyed[length, need], len(names))
            else:
                bag_w = _bags(w[some], n_w[some]) if bag_w is None else bag_w
                if length not in bags:
                    bags[length] = _bags(n[those], n_n[those])
                met = _met_by_bags(some, bag_w, those, bags[length], math.floor(total - cutoff * total / 100.0 + 1e-9))
            for at, to in met:
                left.append((at, to))
                waiting += len(at)
                if waiting >= BLOCK:
                    yield compared()
                    left, waiting = [], 0
    if waiting:
        yield compared()

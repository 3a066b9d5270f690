"""Spans of words held against a document's entities, a stretch of words at a time, in numpy.

Spans are places in a stretch's letters, so none of them is made as a string but those
that match. All pairs of a stretch are looked at, by lengths and counted letters, and
what is left is compared at once, each entity with its match bits made once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from marginalia.functions.similarity import WIDEST, _lcs_of_two

#: Letters of a stretch's words that are worked on at once, and pairs that are compared at once.
LETTERS, BLOCK = 400_000, 16_384
#: Letters fall into so many kinds, each of which is counted up to four.
KINDS = 32
_FOUR = np.array([0, 1, 3, 7, 15], np.uint64)


def _letters(texts: list[str], between: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts behind each other, and where each begins and ends."""
    codes = np.frombuffer(between.join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + len(between)) - len(between)
    return codes, ends - sizes, ends


def _bags(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two longs for each piece of ``codes``: four bits a kind of letter, as many set as it stands there, so bits that differ are letters that only one side has."""
    kinds = (codes.astype(np.int64) * 37 % 61) % KINDS
    so_far = np.zeros((len(codes) + 1, KINDS), np.int32)
    so_far[np.arange(len(codes)) + 1, kinds] = 1
    np.cumsum(so_far, axis=0, out=so_far)
    bits = _FOUR[np.minimum(so_far[last] - so_far[first], 4)] << (np.arange(KINDS, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
    return np.stack([np.bitwise_or.reduce(bits[:, half * 16 : half * 16 + 16], axis=1) for half in (0, 1)])


class _Entities:
    """A text for each entity, with what all pairs need of it."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.sizes = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        codes, first, last = _letters(texts, "")
        self.bags = _bags(codes, first, last)
        self.alphabet, place = np.unique(codes, return_inverse=True)
        self.wide = self.sizes > WIDEST
        whose, at = np.repeat(np.arange(len(texts)), self.sizes), np.arange(len(codes)) - np.repeat(first, self.sizes)
        narrow = ~self.wide[whose]
        self.bits = np.zeros((len(texts), len(self.alphabet) + 1), np.uint64)  # the last column is of letters that no entity has
        np.bitwise_or.at(self.bits, (whose[narrow], place[narrow]), np.uint64(1) << at[narrow].astype(np.uint64))

    def places(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, codes)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == codes[known]
        return np.where(known, at, len(self.alphabet))

    def ratios(self, which: np.ndarray, codes: np.ndarray, places: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``indel_ratio`` of the entities ``which`` and the pieces of ``codes`` from ``first`` on."""
        same = np.zeros(len(which), np.int64)
        by_size = np.argsort(-sizes, kind="stable")  # those that still have letters come first
        for i in range(0, len(which), BLOCK):
            some = by_size[i : i + BLOCK]
            own, at, left = which[some], first[some], sizes[some]
            full = (np.uint64(1) << np.minimum(self.sizes[own], WIDEST).astype(np.uint64)) - np.uint64(1)
            row = full.copy()
            for j in range(int(left[0])):
                n = int(np.searchsorted(-left, -j, "left"))
                hit = row[:n] & self.bits[own[:n], places[at[:n] + j]]
                row[:n] = ((row[:n] + hit) | (row[:n] - hit)) & full[:n]
            same[some] = np.minimum(self.sizes[own], WIDEST) - np.bitwise_count(row)
        for k in np.flatnonzero(self.wide[which]):
            same[k] = _lcs_of_two(self.texts[which[k]], codes[first[k] : first[k] + sizes[k]].tobytes().decode("utf-32-le", "surrogatepass"))
        return 200.0 * same / np.maximum(self.sizes[which] + sizes, 1)


def _may_reach(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """As ``similarity.bag_may_reach``, for each of the one side (rows) and of the other (columns)."""
    total = n[:, None] + m
    apart = sum(np.bitwise_count(a[half][:, None] ^ b[half]).astype(np.int64) for half in (0, 1))
    return (200.0 * np.minimum(n[:, None], m) >= ratio * total - 1e-9) & ((total - apart) * 100.0 >= ratio * total - 1e-9)


def _stretches(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """The rows, some at a time."""
    some, letters = [], 0
    for row in batch.to_pylist():
        some.append(row)
        letters += sum(map(len, row["low"]))
        if letters >= LETTERS:
            yield some
            some, letters = [], 0
    if some:
        yield some


def _found(rows: list[dict], starts: int, skeleton_cutoff: float, cutoff: float) -> tuple[np.ndarray, ...]:
    """Matches of these stretches: row, entity (counted over all rows), level, score, words, first word (counted over all rows)."""
    sizes, per = np.array([len(r["low"]) for r in rows]), np.array([len(r["ours"]) for r in rows])
    word_at, own_at = np.cumsum(sizes) - sizes, np.cumsum(per) - per
    words = np.array([e["words"] for r in rows for e in r["ours"]])
    # a span's text is a piece of all words behind each other, with spaces between; its consonants have none
    kinds = {}
    for kind, between in (("low", " "), ("skel", "")):
        codes, first, last = _letters([t for r in rows for t in r[kind]], between)
        own = _Entities([e[kind] for r in rows for e in r["ours"]])
        kinds[kind] = codes, first, last, own, own.places(codes)
    pairs = {"low": [], "skel": []}
    for i in range(len(rows)):
        mine = slice(own_at[i], own_at[i] + per[i])
        begin = np.arange(min(sizes[i], starts))
        n = np.arange(1, int(words[mine].max()) + 2)
        at, length = (x.ravel() for x in np.meshgrid(begin, n, indexing="ij"))
        fits = at + length <= sizes[i]
        at, length = word_at[i] + at[fits], length[fits]
        short = length[:, None] <= words[mine] + 1
        for kind, ratio in (("low", cutoff), ("skel", skeleton_cutoff)):
            codes, first, last, own, _ = kinds[kind]
            lo, hi = first[at[0]], last[word_at[i] + sizes[i] - 1]
            a, b = first[at], last[at + length - 1]
            may = short & _may_reach(b - a, own.sizes[mine], _bags(codes[lo:hi], a - lo, b - lo), own.bags[:, mine], ratio)
            if kind == "skel":
                may &= (own.sizes[mine] >= 3) & (b > a)[:, None]
            one, other = np.nonzero(may)
            pairs[kind].append((np.full(len(one), i), own_at[i] + other, at[one], length[one]))
    scored = {}
    for kind, parts in pairs.items():
        codes, first, last, own, places = kinds[kind]
        row, which, at, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        scored[kind] = row, which, at, length, own.ratios(which, codes, places, first[at], last[at + length - 1] - first[at])
    # level 2 counts where level 1 doesn't, and level 3 where neither does
    near = {k: [x[v[4] >= c] for x in v] for (k, v), c in zip(scored.items(), (cutoff, skeleton_cutoff), strict=True)}
    most = int(words.max()) + 2
    key = lambda v: (v[1] * (int(sizes.sum()) + 1) + v[2]) * most + v[3]
    same = near["low"][4] == 100.0
    two = [x[~np.isin(key(near["skel"]), key([x[same] for x in near["low"]]))] for x in near["skel"]]
    three = [x[~same & ~np.isin(key(near["low"]), key(near["skel"]))] for x in near["low"]]
    one = [x[same] for x in near["low"]]
    row, which, at, length, score = (np.concatenate(x) for x in zip(one, two, three, strict=True))
    level = np.repeat([1, 2, 3], [len(one[0]), len(two[0]), len(three[0])])
    return row, which, level, score, length, at - word_at[row]


def matcher(starts: int, skeleton_cutoff: float, cutoff: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows of ``doc_id, idx, text, low, skel`` (of a stretch's words) and ``ours`` (``entity, words, low, skel``) to ``doc_id, entity, level, score, span_len, start_idx, ngram, token_indices``. Spans begin at the first ``starts`` words."""

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for rows in _stretches(batch):
                row, which, level, score, length, at = _found(rows, starts, skeleton_cutoff, cutoff)
                names = [e["entity"] for r in rows for e in r["ours"]]
                cut = list(zip(row.tolist(), at.tolist(), (at + length).tolist(), strict=True))
                places = [rows[r]["idx"][i:j] for r, i, j in cut]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[r]["doc_id"] for r, _, _ in cut], kind), pa.array([names[k] for k in which.tolist()], pa.string()), pa.array(level, pa.int32()), pa.array(score, pa.float64()),
                        pa.array(length, pa.int32()), pa.array([p[0] for p in places], pa.int32()), pa.array([" ".join(rows[r]["text"][i:j]) for r, i, j in cut], pa.string()), pa.array(places, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "entity", "level", "score", "span_len", "start_idx", "ngram", "token_indices"],
                )

    return matches

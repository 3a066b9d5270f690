"""SentencePiece encoding and decoding for merge-type vocabularies.

Adjacent symbols wait as pairs in an agenda ordered by score, then from the left; the
best pair merges and its new neighbours join the agenda. Chunks that no piece can
reach over are encoded apart, so a worker encodes a chunk once. Short chunks go through
many at a time: each has a row of pair scores for its agenda, and a step merges the best
pair of every row. Long ones have a heap each. Every new chunk is checked against the
library, and texts that hold one where the two differ take the library's ids.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import spmodel
from marginalia.llm.packing import text_runs

#: Chunks that a worker keeps the ids of, and that it encodes at a time; longest chunks of the agendas that go in step.
KEPT_CHUNKS, SOME_CHUNKS, WIDTHS = 1_000_000, 20_000, (8, 12, 16, 24, 32)
#: No pair, and no symbol.
NEVER, NONE = np.iinfo(np.int32).max, -1


class PairTable:
    """Which piece a pair of symbols makes, and its rank by score: an open hash table for whole arrays of pairs."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float]):
        rank = {x: i for i, x in enumerate(sorted({-s for s in scores.values()}))}
        symbols = {c for p in pieces for c in p} | set(pieces)
        number = pieces | {c: len(pieces) + 2**16 + i for i, c in enumerate(sorted(symbols - set(pieces)))}
        pairs = {(number[p[:i]], number[p[i:]]): p for p in pieces for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.bits = max(8, (4 * len(pairs)).bit_length())
        keys = np.array([(a << 32) + b for a, b in pairs] or [-2], np.int64)
        made, order = np.array([pieces[p] for p in pairs.values()] or [NONE], np.int32), np.array([rank[-scores[p]] for p in pairs.values()] or [NEVER], np.int32)
        self.keys, self.made, self.order = np.full(1 << self.bits, -2, np.int64), np.full(1 << self.bits, NONE, np.int32), np.full(1 << self.bits, NEVER, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == -2
            _, first = np.unique(slot[left], return_index=True)
            first = first[free[first]]
            put = left[first]
            self.keys[slot[put]], self.made[slot[put]], self.order[slot[put]] = keys[put], made[put], order[put]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        char = np.full(0x110000, NONE, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                char[ord(p)] = i
        #: The piece of each code point that is one.
        self.char = char

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that pairs make and their ranks."""
        keys = (a.astype(np.int64) << 32) + b
        slot, wrap = self._slot(keys), (1 << self.bits) - 1
        found = self.keys[slot]
        left = np.flatnonzero((found != keys) & (found != -2))
        while len(left):
            slot[left] = (slot[left] + 1) & wrap
            found = self.keys[slot[left]]
            left = left[(found != keys[left]) & (found != -2)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.made[slot], NONE), np.where(hit, self.order[slot], NEVER)


class PieceCoder:
    def __init__(self, data: bytes):
        import sentencepiece

        self.model = spmodel.parse(data)
        if self.model.model_type != spmodel.BPE:
            raise ValueError("not a merge-type vocabulary")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.ids = {p.text: i for i, p in enumerate(self.model.pieces) if p.kind == spmodel.NORMAL}
        self.minus = {p.text: -p.score for p in self.model.pieces if p.kind == spmodel.NORMAL}
        self.bytes_at, self.tile = self.model.bytes_at, self.model.chunks().findall
        self.head = len(self.library.encode("\n"))
        self.table = PairTable(self.ids, {p: -x for p, x in self.minus.items()})
        self.decimal = [str(i) for i in range(len(self.model.pieces))]
        self._forget()

    def _forget(self) -> None:
        """Of each chunk its number; of each number its ids' place, and the ids in decimal."""
        self.known: dict[str, int] = {}
        self.differs: set[str] = set()
        self.pool, self.size, self.written = np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda."""
        symbols: list[str | None] = list(chunk)
        n, minus = len(symbols), self.minus
        if n > 1:
            after, before = [*range(1, n), -1], [-1, *range(n - 1)]
            agenda = [(minus[p], i, i + 1, 2) for i in range(n - 1) if (p := chunk[i : i + 2]) in minus]
            heapify(agenda)
            while agenda:
                _, i, j, size = heappop(agenda)
                a, b = symbols[i], symbols[j]
                if a is None or b is None or len(a) + len(b) != size:
                    continue
                symbols[i], symbols[j] = (a := a + b), None
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (p := a + symbols[k]) in minus:
                        heappush(agenda, (minus[p], i, k, len(p)))
                if (h := before[i]) >= 0 and (p := symbols[h] + a) in minus:
                    heappush(agenda, (minus[p], h, i, len(p)))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is None:
                    out += [self.bytes_at[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def merge_in_step(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has. Characters are all pieces; a row of pair ranks is a chunk's agenda."""
        n, sizes = len(chunks), np.array([len(c) for c in chunks])
        wide = int(sizes.max()) + 2  # a column without a symbol on either side
        inside = np.arange(wide)[None, :] - 1 < sizes[:, None]
        inside[:, 0] = False
        symbol = np.full((n, wide), NONE, np.int32)
        symbol[inside] = self.table.char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        after = np.broadcast_to(np.arange(1, wide + 1), (n, wide)).copy()
        before = after - 2
        made, rank = np.full((n, wide), NONE, np.int32), np.full((n, wide), NEVER, np.int32)
        made[:, 1:-1], rank[:, 1:-1] = (x.reshape(n, -1) for x in self.table.find(symbol[:, 1:-1].ravel(), symbol[:, 2:].ravel()))
        rows = np.arange(n)
        while True:
            at = rank[rows].argmin(axis=1)
            some = rank[rows, at] != NEVER
            rows, at = rows[some], at[some]
            if not len(rows):
                break
            gone = after[rows, at]
            then, ahead = after[rows, gone], before[rows, at]
            new = made[rows, at]
            symbol[rows, at], symbol[rows, gone], rank[rows, gone] = new, NONE, NEVER
            after[rows, at], before[rows, then] = then, at
            made[rows, at], rank[rows, at] = self.table.find(new, symbol[rows, then])
            made[rows, ahead], rank[rows, ahead] = self.table.find(symbol[rows, ahead], new)
        alive = symbol != NONE
        return symbol[alive], alive.sum(axis=1)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, and check them against the library."""
        plain, decimal, head = self.table.char, self.decimal, self.head
        pool, size = [self.pool], [self.size]
        for at in range(0, len(chunks), SOME_CHUNKS):
            part = sorted(chunks[at : at + SOME_CHUNKS], key=len)
            sizes = np.array([len(c) for c in part])
            known = plain[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)] != NONE
            whole = np.logical_and.reduceat(known, np.cumsum(sizes) - sizes)
            found: dict[int, list[int]] = {}
            for low, high in zip((0, *WIDTHS), WIDTHS, strict=False):
                some = np.flatnonzero(whole & (sizes > low) & (sizes <= high)).tolist()
                if some:
                    ids, n = self.merge_in_step([part[i] for i in some])
                    ends, ids = np.cumsum(n).tolist(), ids.tolist()
                    found.update((i, ids[b:e]) for i, b, e in zip(some, [0, *ends], ends, strict=False))
            checks = self.library.encode(["\n" + c.replace(spmodel.SPACE, " ") for c in part])
            every = [found[i] if i in found else self.merge(c) for i, c in enumerate(part)]
            self.differs.update(c for c, ids, check in zip(part, every, checks, strict=True) if ids != check[head:])
            self.written += [",".join([decimal[x] for x in ids]) for ids in every]
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            pool.append(np.array([x for ids in every for x in ids], np.int32))
            size.append(np.array([len(ids) for ids in every], np.int64))
        self.pool, self.size = np.concatenate(pool), np.concatenate(size)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of each text, and the same in decimal, comma-joined."""
        split = [self.tile(self.model.normalise(t)) for t in texts]
        coded = pa.array([c for chunks in split for c in chunks], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [c for c in distinct if c not in self.known]
        if len(self.known) + len(new) > KEPT_CHUNKS:
            self._forget()
            new = distinct
        if new:
            self.learn(new)
        numbers = np.array([self.known[c] for c in distinct], np.int64)
        written = [self.written[i] for i in numbers.tolist()]
        begin = (np.cumsum(self.size) - self.size)[numbers]
        local, size = coded.indices.to_numpy(), self.size[numbers]
        ends = np.cumsum([len(chunks) for chunks in split]).tolist()
        for text, chunks, low, high in zip(texts, split, [0, *ends], ends, strict=False):
            if self.differs and not self.differs.isdisjoint(chunks):
                ids = self.library.encode(text)
                yield ids, ",".join(map(str, ids))
                continue
            at = local[low:high]
            n = size[at]
            ids = self.pool[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield ids.tolist(), ",".join([written[i] for i in at.tolist()])


@functools.lru_cache(2)
def _coder(path: str) -> PieceCoder:
    return PieceCoder(spmodel.read(path))


def encode_decode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id`` with ``ids`` array<int> and ``decoded`` string, or with their number and digests.

    Every text is encoded whole (null: empty, which has no ids); a row for each row of
    ``docs``, repeated ones too; an empty table stays empty. Ids may have any type;
    other columns don't matter.
    """
    kind = docs.schema[id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for keys, texts in text_runs(batches, 1_000_000):
            found = [(ids, written, coder.library.decode(ids)) for ids, written in coder.encode(texts.to_pylist())]
            if digests:
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                columns = [pa.array([len(x[0]) for x in found], pa.int64()), pa.array([sha(x[1]) for x in found], pa.string()), pa.array([sha(x[2]) for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id), F.col(text)).mapInArrow(work, f"doc_id {kind}, {rest}")

"""Language-model scores: n-gram estimates mixed by deleted interpolation.

Documents are dealt to blocks of some megabytes of text. A block sends the distinct
n-grams it holds, with their counts, to buckets of the hash range, sorted and packed
as differences; a bucket adds up the counts of all blocks and answers each block in
the order it asked. So neither the vocabulary nor a common n-gram is ever in one task:
a bucket holds a bounded range of hashes, and an n-gram once for each block at most.
A block sends a row to each bucket, so beyond GROWS_FROM bytes of text both grow with
the root of the input (to GROWS_BY times, as far as a worker's memory goes): rows then
keep their length, and their number grows as the n-grams do. Every block and every
bucket is a partition of its own, so tasks don't grow with the input. Words and n-grams
stand for their 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut
from marginalia.llm.neardup import mix

#: Bytes of text of a block, n-grams asked for in a bucket, least number of blocks.
BLOCK_BYTES, BUCKET_GRAMS, LEAST_BLOCKS = 8_000_000, 1_000_000, 16
#: Bytes of text from which blocks and buckets grow, and by how much at most.
GROWS_FROM, GROWS_BY = 50_000_000_000, 8.0
#: One in so many learning documents is set aside while the weights are learned.
FOLDS = 8
#: Steps of an octave to which probabilities are rounded for learning weights (not for scores).
STEPS = 4
ROUNDS = 60


class Words:
    """Words of lower-cased (A-Z) texts as hashes; a worker keeps those it has met."""

    def __init__(self, kept: int = 700_000):
        import xxhash

        self.kept, self.hash, self.known = kept, xxhash.xxh64_intdigest, {}
        self.start, self.end = np.uint64(self.hash(b"\n\n")), np.uint64(self.hash(b"\n"))

    def of(self, text: str) -> list[int]:
        if len(self.known) > self.kept:
            self.known.clear()
        known, out = self.known, []
        for w in text.encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = self.hash(w)
            out.append(h)
        return out


@functools.lru_cache(1)
def _words() -> Words:
    return Words()


class Block:
    """The tokens of a block's texts in order, and for each the n-grams of orders 1 and 2 that it ends."""

    def __init__(self, texts: list[str | None]):
        words = _words()
        runs = [np.array(words.of(t or ""), dtype=np.uint64) for t in texts]
        self.sizes = np.array([len(r) + 1 for r in runs])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        end = np.array([words.end])
        self.tokens = np.concatenate([x for r in runs for x in (r, end)] or [np.zeros(0, np.uint64)])
        self.before = np.roll(self.tokens, 1)
        self.before[self.starts] = words.start
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.starts] = True
        self.grams = {1: self.tokens, 2: mix(mix(self.before) ^ self.tokens)}


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as a width and as many low bytes of each difference."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    low = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(low), 8), np.uint8)
    steps[:, :width] = low
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts as a width (1, 2, 4 or 8 bytes) and the numbers."""
    most = int(counts.max()) if len(counts) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.float64)


def _bucket_edges(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted hashes: the buckets that have some, and where each begins (and the end)."""
    at = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    found, begin = np.unique(at, return_index=True)
    return found.astype(np.int64), np.append(begin, len(hashes))


def _requests(buckets: dict[int, int]):
    def work(t: pa.Table) -> pa.Table:
        block, fold = t.column("block")[0].as_py(), t.column("fold")[0].as_py()
        b = Block(t.column("text").to_pylist())
        learns = np.repeat(~t.column("held_out").to_numpy(zero_copy_only=False).astype(bool), b.sizes)
        rows = []
        for order, grams in b.grams.items():
            keys, at = np.unique(grams, return_inverse=True)
            counts = np.bincount(at, learns, len(keys)).astype("<u8")
            found, edges = _bucket_edges(keys, buckets[order])
            before = 0 if order == 2 else buckets[2]
            rows += [(before + int(k), block, fold, order, int(k), packed(keys[i:j]), narrow(counts[i:j])) for k, i, j in zip(found, edges[:-1], edges[1:], strict=True)]
        return pa.Table.from_pylist([dict(zip(("slot", "block", "fold", "order", "bucket", "hashes", "counts"), r, strict=True)) for r in rows], pa.schema([("slot", pa.int32()), ("block", pa.int32()), ("fold", pa.bool_()), ("order", pa.int32()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    return work


def _answers(t: pa.Table) -> pa.Table:
    """Counts of a bucket's n-grams over all learning documents and over those set aside, for each block that asked."""
    order, fold = t.column("order")[0].as_py(), t.column("fold").to_pylist()
    hashes = [unpacked(x) for x in t.column("hashes").to_pylist()]
    counts = [wide(x) for x in t.column("counts").to_pylist()]
    keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
    every = np.concatenate(counts)
    total = np.bincount(at, every, len(keys)).astype("<u8")
    aside = np.bincount(at, every * np.repeat(fold, [len(x) for x in hashes]), len(keys)).astype("<u8")
    edges = np.cumsum([0, *(len(x) for x in hashes)])
    rows = [(b, order, k, narrow(total[at[i:j]]), narrow(aside[at[i:j]]) if f else b"") for b, k, f, i, j in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), fold, edges[:-1], edges[1:], strict=True)]
    names, kinds = ("block", "order", "bucket", "total", "aside"), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    sums = [[int(total.sum()), int((total > 0).sum()), int(aside.sum())] if order == 1 else [0, 0, 0], *[[0, 0, 0]] * (len(rows) - 1)]
    return pa.table({**dict(zip(names, arrays, strict=True)), **{n: pa.array([s[i] for s in sums], pa.int64()) for i, n in enumerate(("tokens", "words", "aside_tokens"))}})


def _counts(b: Block, answers: pa.Table, column: str) -> dict[int, np.ndarray]:
    """For each token, the count of the n-gram of each order that it ends."""
    out = {}
    rows = sorted(zip(answers.column("order").to_pylist(), answers.column("bucket").to_pylist(), answers.column(column).to_pylist(), strict=True), key=lambda r: r[:2])
    for order, grams in b.grams.items():
        found = np.concatenate([wide(x) for o, _, x in rows if o == order])
        out[order] = found[np.unique(grams, return_inverse=True)[1]]
    return out


@dataclass(frozen=True)
class Totals:
    """Learning documents, their tokens and distinct tokens; documents and tokens set aside."""

    docs: int
    tokens: int
    words: int
    aside_docs: int
    aside_tokens: int


def _estimates(b: Block, counts: dict[int, np.ndarray], docs: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's context bucket (0: never seen, else 1 + log2 of its count), and its estimates of orders 2 and 1."""
    context = np.roll(counts[1], 1)
    context[b.first] = docs
    bucket = np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)
    return bucket, counts[2] / np.maximum(context, 1), counts[1] / max(tokens, 1)


def _events(totals: Totals):
    """Set-aside tokens by context bucket and rounded estimates from the other documents."""

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = pa.schema([("b", pa.int64()), ("q2", pa.int64()), ("q1", pa.int64()), ("n", pa.int64())])
        if not docs.num_rows:
            return kinds.empty_table()
        b = Block(docs.column("text").to_pylist())
        every, aside = _counts(b, answers, "total"), _counts(b, answers, "aside")
        bucket, p2, p1 = _estimates(b, {k: every[k] - aside[k] for k in every}, totals.docs - totals.aside_docs, totals.tokens - totals.aside_tokens)
        level = lambda p: np.where(p > 0, np.round(-STEPS * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int64)
        keys, n = np.unique(np.stack([bucket, level(p2), level(p1)]), axis=1, return_counts=True)
        return pa.table([pa.array(keys[0]), pa.array(keys[1]), pa.array(keys[2]), pa.array(n)], schema=kinds)

    return work


def learn_weights(events: np.ndarray, words: int) -> np.ndarray:
    """Weights of the orders 2, 1 and 0 by context bucket, by expectation-maximisation.

    ``events``: rows of bucket, rounded estimates (in steps below 1, -1 for none) and
    number. All tokens together come first, and stand for one token more in each
    bucket; contexts never seen give nothing to order 2. No events: equal weights.
    """
    w = np.tile(np.array([1 / 3, 1 / 3, 1 / 3]), (65, 1))
    w[0] = [0, 1 / 2, 1 / 2]
    if not len(events):
        return w
    b, n = events[:, 0], events[:, 3].astype(np.float64)
    p = np.stack([np.where(q >= 0, 2.0 ** (-q / STEPS), 0.0) for q in (events[:, 1], events[:, 2])] + [np.full(len(b), 1 / (words + 1))], axis=1)
    some = np.array([1 / 3, 1 / 3, 1 / 3])
    for _ in range(ROUNDS):
        share = p * some
        some = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
    for _ in range(ROUNDS):
        share = p * w[b]
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(b, share[:, k], 65) for k in range(3)], axis=1) + some
        sums[0, 0] = 0
        w = sums / sums.sum(axis=1, keepdims=True)
    return w


def _scores(totals: Totals, weights: np.ndarray, kind: pa.DataType):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        if not docs.num_rows:
            return schema.empty_table()
        b = Block(docs.column("text").to_pylist())
        counts = _counts(b, answers, "total")
        bucket, p2, p1 = _estimates(b, counts, totals.docs, totals.tokens)
        w = weights[bucket]
        mixed = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (totals.words + 1))
        base = np.log10((counts[1] + 1) / (totals.tokens + totals.words + 1))
        sums = lambda x: np.add.reduceat(x, b.starts)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(b.sizes), pa.array(sums((counts[1] > 0).astype(np.int64))), pa.array(np.full(len(b.sizes), totals.tokens)), pa.array(sums(base)), pa.array(sums(mixed))], schema=schema)

    return work


def sizes_for(size: int) -> tuple[int, dict[int, int]]:
    """Blocks, and buckets by order, for so many bytes of text."""
    grown = min(GROWS_BY, max(1.0, math.sqrt(size / GROWS_FROM)))
    return max(LEAST_BLOCKS, math.ceil(size / (BLOCK_BYTES * grown))), {order: max(1, math.ceil(size / per_gram / (BUCKET_GRAMS * grown))) for order, per_gram in ((2, 6), (1, 60))}


def score(docs: DataFrame, held_out: Column, aside: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Tokens are the lower-cased (A-Z) words of the whole text and one end. The model
    learns from rows where ``held_out`` isn't true: a bigram, a unigram and a uniform
    estimate, mixed with weights by the frequency of the context; the weights are
    learned by expectation-maximisation on the learning rows where ``aside`` is true,
    with their own counts deleted. base_score adds one to unigram counts. Both are sums
    of log10. Null texts are empty: one token, the end. Repeated rows count and are
    scored each (rows of one id and text share a block); no learning rows: counts of 0.
    Empty table: empty.
    """
    kind = docs.schema[id].dataType
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"), (~held & F.coalesce(aside, F.lit(False))).alias("fold"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out")), F.count_if("fold")).first()
    blocks, buckets = sizes_for(size[0] or 0)
    apart = max(LEAST_BLOCKS // 4, blocks // FOLDS)
    deal = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("block", F.when(F.col("fold"), blocks + F.pmod(deal, F.lit(apart))).otherwise(F.pmod(deal, F.lit(blocks))).cast("int"))
    dealt = rows.repartitionById(blocks + apart, "block")
    asked = dealt.groupBy("block").applyInArrow(_requests(buckets), "slot int, block int, fold boolean, order int, bucket long, hashes binary, counts binary")
    answered = cut(asked.repartitionById(sum(buckets.values()), "slot").groupBy("slot").applyInArrow(_answers, "block int, order int, bucket long, total binary, aside binary, tokens long, words long, aside_tokens long"))
    sums = answered.agg(F.sum("tokens"), F.sum("words"), F.sum("aside_tokens")).first()
    totals = Totals(size[1], sums[0] or 0, sums[1] or 0, size[2], sums[2] or 0)
    answers = answered.select("block", "order", "bucket", "total", "aside")
    by_block = lambda df, n, first=0: df.withColumn("block", F.col("block") - F.lit(first)).repartitionById(n, "block").groupBy("block")
    folded = by_block(rows.where("fold"), apart, blocks).cogroup(by_block(answers.where(F.col("block") >= blocks), apart, blocks))
    events = folded.applyInArrow(_events(totals), "b long, q2 long, q1 long, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))
    learned = events.toPandas().to_numpy(dtype=np.int64).reshape(-1, 4)  # bounded: 65 buckets x rounded estimates
    weights = learn_weights(learned[np.lexsort(learned.T[::-1])], totals.words)
    from pyspark.sql.pandas.types import to_arrow_type

    out = dealt.groupBy("block").cogroup(by_block(answers, blocks + apart)).applyInArrow(
        _scores(totals, weights, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out


def split_by_id(id: str = "doc_id") -> tuple[Column, Column]:
    """Held out: crc32 of the id as text leaves 2 by 7; set aside for weights: an eighth of the rest."""
    crc = F.crc32(F.col(id).cast("string"))
    return crc % 7 == 2, F.floor(crc / 7) % FOLDS == 0

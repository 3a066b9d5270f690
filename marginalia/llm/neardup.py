"""Near duplicates of texts: BagMinHash signatures of word-shingle multisets, bands, exact check, components.

Texts that are equal are one from the start: a task signs each text once, however many
copies it meets, and what tasks sign twice becomes one before the bands. Band buckets are
first reduced to their least member, and every other member is held against that one
only; buckets in which members of different classes remain are then looked through in
blocks, by signatures alone. Only members with a promising partner there get their
texts for an exact check, and only links between classes leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, cut, discard, fresh, spread_join
from marginalia.llm.packing import text_runs

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 6 registers: two texts of similarity 0.8 share a band with probability 0.9993.
BANDS, ROWS = 24, 6
#: Pairs whose signatures agree in less than this share are not checked: 4.5 standard deviations below 0.8.
HOPELESS = 0.65
#: Members of a bucket that one task compares with each other at a time.
BLOCK = 512
#: Texts that a task remembers to have signed.
SIGNED = 500_000
_ONE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = x + _ONE
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to multisets of shingles: sorted 64-bit hashes and their counts.

    Words are runs of anything but white space, compared exactly. A text of under five
    words has one shingle, of all its words; one without words has none.
    """

    def __init__(self, size: int = SHINGLE, kept: int = 200_000):
        self.size, self.kept, self.known = size, kept, {}

    def hashes(self, text: str) -> np.ndarray:
        import xxhash

        if len(self.known) > self.kept:
            self.known.clear()
        known, out = self.known, []
        for w in text.encode("utf-8", "surrogatepass").split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h = self.hashes(text)
        n = min(self.size, len(h))
        if not n:
            return h, h.astype(np.int64)
        rolled = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            rolled = mix(rolled ^ h[k : len(h) - n + 1 + k])
        return np.unique(rolled, return_counts=True)


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash: for each bag, ``m`` registers; two bags agree in a register with the probability of their weighted Jaccard index.

    Each element has independent Poisson processes over time on the weight intervals
    [0, 1), [1, 2), [2, 4), [4, 8) ... that its count reaches. The first point of a
    process wider than 1 splits it in two halves, one of which keeps the point and
    the other goes on from there; halves above the count are dropped. Points of unit
    processes fall on a register each, which keeps the earliest point (its time, mixed:
    no two points share one). Processes end once they are later than the latest
    register of their bag. Bags need an element each.
    """
    d = len(bags)
    sizes = np.array([len(b[0]) for b in bags])
    owner = np.repeat(np.arange(d), sizes)
    element = np.concatenate([b[0] for b in bags] or [np.zeros(0, np.uint64)])
    count = np.concatenate([b[1] for b in bags] or [np.zeros(0, np.int64)])
    parts = [(owner, mix(element), count, np.zeros(len(element), np.int64), np.ones(len(element), np.int64))]
    low = 1
    while (more := count > low).any():
        owner, element, count = owner[more], element[more], count[more]
        parts.append((owner, mix(element ^ mix(np.full(len(element), low + 1, np.uint64))), count, np.full(len(element), low), np.full(len(element), low)))
        low *= 2
    doc, seed, weight, lo, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = -np.log(_uniform(seed)) / (m * width)
    best = np.full(d * m, np.inf)
    while len(doc):
        unit = width == 1
        u_doc, u_seed, u_time = doc[unit], seed[unit], time[unit]
        at = u_doc * m + (mix(u_seed ^ _MIX1) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, at, u_time)
        limit = best.reshape(d, m).max(axis=1)
        u_seed = mix(u_seed)
        new = [(u_doc, u_seed, weight[unit], lo[unit], width[unit], u_time - np.log(_uniform(u_seed)) / m)]
        if not unit.all():
            s_doc, s_seed, s_weight, s_lo, s_time = doc[~unit], seed[~unit], weight[~unit], lo[~unit], time[~unit]
            half = width[~unit] // 2
            left = (mix(s_seed ^ _MIX1) & np.uint64(1)).astype(bool)
            for side in (True, False):
                begin = s_lo if side else s_lo + half
                child = mix(s_seed ^ np.uint64(3 if side else 5))
                first = np.where(left == side, s_time, s_time - np.log(_uniform(child)) / (m * half))
                fits = begin < s_weight
                new.append((s_doc[fits], mix(child[fits]), s_weight[fits], begin[fits], half[fits], first[fits]))
        doc, seed, weight, lo, width, time = (np.concatenate(x) for x in zip(*new, strict=True))
        live = time <= limit[doc]
        doc, seed, weight, lo, width, time = (x[live] for x in (doc, seed, weight, lo, width, time))
    return mix(best.view(np.uint64)).reshape(d, m)


def band_keys(sigs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sigs.reshape(len(sigs), bands, -1)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, k])
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser counts over sum of the greater; 0 if neither has any."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def sketch(texts: DataFrame) -> DataFrame:
    """``node`` and ``text`` to ``node, sig, bands``: one byte of each register, and a key for each band; texts without words give no row, and copies within a task one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signed = Shingler(), set()
        for nodes, run in text_runs(batches, 1_000_000):
            if len(signed) > SIGNED:
                signed.clear()
            names = nodes.to_pylist()
            new = [i for i, n in enumerate(names) if not (n in signed or signed.add(n))]
            kept = [(names[i], b) for i, b in zip(new, map(shingler.bag, run.take(pa.array(new, pa.int64())).to_pylist()), strict=True) if len(b[0])]
            if kept:
                sigs = signatures([b for _, b in kept], BANDS * ROWS)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sigs).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.binary()), pa.array([x.astype(np.uint8).tobytes() for x in sigs], pa.binary()), keys], ["node", "sig", "bands"])

    return texts.select("node", "text").mapInArrow(work, "node binary, sig binary, bands array<long>")


def _hopeful(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree often enough for an exact check."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            side = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1)  # noqa: E731, B023
            ok = (side("sa") == side("sb")).mean(axis=1) >= HOPELESS if t.num_rows else np.zeros(0, bool)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    one, other = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole texts have a multiset overlap of 0.8 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for t in batches:
            ok, last, bag = [], None, None
            for a, x, y in zip(t.column("a"), t.column("ta"), t.column("tb"), strict=True):
                if bag is None or a != last:
                    last, bag = a, shingler.bag(x.as_py())
                ok.append(weighted_jaccard(bag, shingler.bag(y.as_py())) >= SIMILARITY)
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, other = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(other.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def _promising(k: int, sigs: np.ndarray, keys: np.ndarray, names: np.ndarray, one: np.ndarray, other: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some members at a time: their numbers, how far each pair's signatures agree, and which pairs to check: of different classes, near enough, met in no earlier band."""
    for some in np.array_split(one, len(one) // 32 + 1):
        agree = (sigs[some][:, None, :] == sigs[other][None, :, :]).mean(axis=2)
        near = (agree >= HOPELESS) & (names[some][:, None] != names[other][None, :]) & ~(keys[some][:, None, :k] == keys[other][None, :, :k]).any(axis=2)
        if same:
            near &= some[:, None] < other[None, :]
        yield some, agree, near


def _block_of(t: pa.Table) -> tuple:
    k, p, q, own = t.column("k")[0].as_py(), t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("own").to_numpy()
    sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    names = pd.factorize(pd.Series(t.column("class").to_pylist()))[0]
    return k, sigs, keys, names, np.flatnonzero(own == p), np.flatnonzero(own == q), p == q


def _members(t: pa.Table) -> pa.Table:
    """The members of a pair of blocks that have a promising partner in it."""
    block, found = _block_of(t), np.zeros(t.num_rows, bool)
    for some, _, near in _promising(*block):
        found[some] |= near.any(axis=1)
        found[block[5]] |= near.any(axis=0)
    return t.select(["k", "band", "p", "q", "own", "class", "node"]).filter(pa.array(found))


def _links(t: pa.Table) -> pa.Table:
    """``a, b``: links that join the classes of a pair of blocks, the most promising pairs checked first."""
    block = _block_of(t)
    names, other = block[3], block[5]
    pairs = [np.zeros((3, 0))]
    for some, agree, near in _promising(*block):
        i, j = np.nonzero(near)
        pairs.append(np.stack([-agree[i, j], some[i], other[j]]))
    found = np.concatenate(pairs, axis=1)
    found = found[:, np.argsort(found[0], kind="stable")]
    up, bags, links, nodes, texts, shingler = list(range(len(names))), {}, [], t.column("node"), t.column("text"), Shingler()

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in bags:
            bags[i] = shingler.bag(texts[i].as_py())
        return bags[i]

    for i, j in zip(found[1].astype(int).tolist(), found[2].astype(int).tolist(), strict=True):
        x, y = root(int(names[i])), root(int(names[j]))
        if x != y and weighted_jaccard(bag(i), bag(j)) >= SIMILARITY:
            up[x] = y
            links.append((nodes[i].as_py(), nodes[j].as_py()))
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def _bucket_links(named: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: links between classes that a bucket's members (``k, band, node, class``) have, as far as exact checks find them.

    Buckets of several classes are dealt out in blocks by their size, each pair of
    blocks to a task of its own. The sizes are added up before the shuffle, and go to
    several deals of a band, so that no task gets all of a large one.
    """
    sizes = named.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2")
    sizes = sizes.select("band", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("n"))
    dealt = spread_join(named, sizes, ["band"], ["node"]).withColumn("own", F.pmod(F.xxhash64("node"), "n").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("k", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "class", "node")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    signed = dealt.join(sketches.hint("merge"), "node")
    members = cut(signed.groupBy("k", "band", "p", "q").applyInArrow(_members, kinds))
    whole = members.join(sketches.hint("merge"), "node").join(texts.hint("merge"), "node")
    return whole.groupBy("k", "band", "p", "q").applyInArrow(_links, "a binary, b binary")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_class, kept``: a row for each row of ``docs``.

    Documents link if the multisets of their 5-word shingles overlap by 0.8 or more
    (sum of lesser counts over sum of greater), equal texts with a word always; class_id
    is the least id that links reach, and ``kept`` marks the rows with that id. Texts
    without words (null, empty, white space) link with nothing: each such id is its own
    class. Rows that repeat an id are kept or dropped together. Null ids form classes
    only where no id is there. Empty table: empty.
    """
    key = F.unhex(F.md5(F.encode(F.col(text), "UTF-8")))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = cut(docs.select(F.col(id).alias("doc_id"), F.when(worded, key).alias("node")))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    texts = docs.where(worded).select(F.col(id).alias("least"), key.alias("node"), F.col(text).alias("text"))
    sketches = cut(sketch(texts).groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    sigs, bands = sketches.select("node", "sig"), sketches.select("node", F.posexplode("bands").alias("k", "band"))
    least = bands.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(bands.join(least.hint("merge"), "band"))
    wanted = members.select("node").distinct().join(nodes.select("node", "least").hint("merge"), "node")
    chosen = texts.join(wanted.hint("merge"), (texts["node"] == wanted["node"]) & texts["least"].eqNullSafe(wanted["least"]), "left_semi")
    chosen = cut(chosen.select("node", "text").dropDuplicates(["node"]))
    tried = cut(members.where("a <> node").select("a", F.col("node").alias("b")).distinct())
    roots = cut(components(verified(_hopeful(tried, sigs), chosen)))
    named = members.select("k", "band", "node").join(roots.hint("merge"), "node", "left").select("k", "band", "node", F.coalesce("root", "node").alias("class"))
    more = cut(_bucket_links(named, sketches, chosen))
    if not more.isEmpty():
        roots = cut(components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)))
    for done in (sketches, members, chosen, tried, more):
        discard(done)
    linked = cut(nodes.join(roots.hint("merge"), "node"))
    found = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"))
    copies = nodes.where("n > 1").join(roots.select("node").hint("merge"), "node", "left_anti").select("node", F.col("least").alias("class_id"), F.col("n").alias("n_class"))
    by_node = spread_join(linked.select("node", "root"), found, ["root"], ["node"]).select("node", "class_id", "n_class").unionByName(copies)
    out = spread_join(rows, by_node, ["node"], ["doc_id"], "left")  # rows that are alone find none
    class_id = F.when(F.col("n_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    out = out.select("doc_id", class_id, F.coalesce("n_class", F.lit(1)).alias("n_class"))
    return out.select("doc_id", "class_id", "n_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, with all columns; rows without words all stay.

    Where ids repeat, one row of each kept id and text stays.
    """
    k = fresh(docs, "_kept_id")
    found = classes(docs, id, text).where("kept").groupBy(F.col("doc_id").alias(k)).agg(F.count("*").alias("n"))
    found = cut(found)
    kept = found.select(k)
    left = docs.join(kept.hint("merge"), docs[id].eqNullSafe(kept[k]), "left_semi")
    return left if found.where("n > 1").isEmpty() else left.dropDuplicates([id, text])

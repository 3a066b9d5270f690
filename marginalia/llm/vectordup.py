"""Near duplicates of vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one from the start. In each table vectors with equal signs meet in a
bucket, as ids with a sketch of SKETCH signs; buckets are dealt out in pairs of blocks.
A first look at the sketches names the members that may have a link there which no
earlier table has brought up; only those get their vectors, and a pair counts in the
first table that brings it together, so sums need no list of pairs. A task hands on,
for each vector, how many it linked and the least of its local component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, cut, discard, spread_join

COSINE, RECALL = 0.9, 0.999
#: Vectors that a bucket holds on average, and that a task compares with others at a time.
BUCKET, BLOCK = 512, 1024
#: Signs of a sketch, and by how many standard deviations a pair at the limit may differ in more of them than it should.
SKETCH, SIGMAS = 192, 5.0
#: Buckets of several blocks that are broadcast; more are joined by salt.
BROADCAST_BUCKETS = 200_000
SEED = 20240229
WORDS = [f"s{i}" for i in range(SKETCH // 64)]


def tables_for(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table, growing with the logarithm of the rows, and the tables that find a pair at ``cosine`` with probability ``recall``."""
    bits = max(4, min(60, round(math.log2(max(rows, 1) / BUCKET + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of double length 1; scaled first, so that huge and tiny components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def most_apart(signs: int, cosine: float) -> int:
    """Signs of ``signs`` that a pair at ``cosine`` differs in at most, but for one in millions."""
    p = math.acos(cosine) / math.pi
    return math.floor(signs * p + SIGMAS * math.sqrt(signs * p * (1 - p)))


def signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """``rep, copies, dim, v`` to the same with ``keys`` (for each table, the sides of ``bits`` random hyperplanes as a number), ``signs`` (all sides, packed) and ``s0, s1, s2`` (the first SKETCH of them; more planes make up for tables of few bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        every = max(bits * tables, SKETCH)
        for t in batches:
            dims, sides = t.column("dim").to_numpy(), np.zeros((t.num_rows, every), bool)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), every))
                x = _unit(_matrix(t.column("v").take(pa.array(at))).astype(np.float64))
                for some in np.array_split(np.arange(len(at)), len(at) // 2048 + 1):
                    sides[at[some]] = x[some] @ planes[d] > 0
            keys = sides[:, : bits * tables].reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            packed = np.packbits(sides, axis=1, bitorder="little")
            sketch = np.ascontiguousarray(packed[:, : SKETCH // 8]).view("<i8").reshape(t.num_rows, -1)
            rows = [x.tobytes() for x in packed]
            yield pa.RecordBatch.from_arrays([*t.columns, lists, pa.array(rows, pa.binary()), *map(pa.array, sketch.T)], [*t.schema.names, "keys", "signs", *WORDS])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(work, f"rep long, copies long, dim int, v {kind}, keys array<long>, signs binary, s0 long, s1 long, s2 long")


def _near(one: np.ndarray, other: np.ndarray, words: np.ndarray, table: int, bits: int, apart: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers, some at a time, that are near by their sketches and meet in no earlier table that the sketch covers."""
    covered = [(k * bits, (k + 1) * bits) for k in range(min(table, SKETCH // bits))]
    masks = [[np.uint64(((1 << end) - (1 << begin) >> 64 * w) & 2**64 - 1) for w in range(len(WORDS))] for begin, end in covered]
    for some in np.array_split(one, len(one) // 256 + 1):
        differ = sum(np.bitwise_count(words[some, w][:, None] ^ words[other, w][None, :]) for w in range(len(WORDS)))
        i, j = np.nonzero(differ <= apart)
        a, b = some[i], other[j]
        if same:
            a, b = a[a < b], b[a < b]
        x = words[a] ^ words[b]
        new = np.ones(len(a), bool)
        for mask in masks:
            new &= np.any([x[:, w] & m for w, m in enumerate(mask) if m], axis=0)
        yield a[new], b[new]


def _members(bits: int, cosine: float):
    """A block's members that may have a link there."""
    apart = most_apart(SKETCH, cosine)

    def work(t: pa.Table) -> pa.Table:
        table, p, q = (t.column(c)[0].as_py() for c in ("table", "p", "q"))
        own = t.column("own").to_numpy()
        words = np.stack([t.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in WORDS], axis=1)
        found = np.zeros(t.num_rows, bool)
        for a, b in _near(np.flatnonzero(own == p), np.flatnonzero(own == q), words, table, bits, apart, p == q):
            found[a] = found[b] = True
        return t.select(["table", "sign", "p", "q", "own", "rep"]).filter(pa.array(found))

    return work


def _links(bits: int, cosine: float):
    """``rep, n, root`` of a block: links that it finds, by vector.

    n: copies of the vectors linked; root: least vector of the local component.
    """

    def work(t: pa.Table) -> pa.Table:
        table, own = t.column("table")[0].as_py(), t.column("own").to_numpy()
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        signs = np.unpackbits(np.frombuffer(b"".join(t.column("signs").to_pylist()), np.uint8).reshape(len(rep), -1), axis=1, bitorder="little")[:, : table * bits]
        keys = signs.reshape(len(rep), table, bits) @ (1 << np.arange(bits, dtype=np.int64))
        x = _unit(_matrix(t.column("v").combine_chunks()).astype(np.float64))
        one, other = np.flatnonzero(own == p), np.flatnonzero(own == q)
        n, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in np.array_split(one, len(one) // 256 + 1):
            near = x[some] @ x[other].T >= cosine
            if p == q:
                near &= some[:, None] < other[None, :]
            i, j = np.nonzero(near)
            for at in range(0, len(i), 100_000):
                a, b = some[i[at : at + 100_000]], other[j[at : at + 100_000]]
                new = ~(keys[a] == keys[b]).any(axis=1)
                a, b = a[new], b[new]
                np.add.at(n, a, copies[b])
                np.add.at(n, b, copies[a])
                a_all.append(a)
                b_all.append(b)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = root
        root = rank.copy()
        while len(a):
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = np.minimum(root, root[order[root]])
        out = np.flatnonzero(n > 0)
        return pa.table({"rep": rep[out], "n": n[out], "root": rep[order[root[out]]]})

    return work


def link(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each row of ``vectors``.

    Vectors link at a cosine (in double precision) of ``cosine`` or more, whatever else
    their rows hold; ``n_links`` counts other rows linked directly, equal vectors among
    them; a component's id is its least vec_id, and ``kept`` marks the rows with that
    id. A pair at ``cosine`` exactly is found with probability ``recall``, closer ones
    more often; pairs below it never count. Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing; vectors of different
    lengths never link. Rows that repeat a vec_id are rows of their own: each has the
    links of its own vector, and different vectors under one id link only if they are
    near. Empty table: empty.
    """
    v = F.col(vector)
    sound = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    keyed = rows.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))  # two hashes stand for a vector
    distinct = keyed.where("v is not null").groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    bits, tables = tables_for(vectors.count(), cosine, recall)
    named = cut(distinct.select(F.monotonically_increasing_id().alias("rep"), "h", "g", "least", "copies", F.size("v").alias("dim"), "v"))
    made = cut(signed(named.select("rep", "copies", "dim", "v"), bits, tables))
    tabled = made.select("rep", "dim", *WORDS, F.posexplode("keys").alias("table", "sign")).withColumn("sign", F.xxhash64("dim", "sign")).drop("dim")
    sizes = made.select("dim", F.posexplode("keys").alias("table", "sign")).groupBy("table", F.xxhash64("dim", "sign").alias("sign")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n"))
    large = cut(sizes.where("n > 1"))
    few = large.count() <= BROADCAST_BUCKETS
    dealt = tabled.join(F.broadcast(large), ["table", "sign"], "left") if few else spread_join(tabled, large, ["table", "sign"], ["rep"], "left")
    dealt = dealt.withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "n").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("table", "sign", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", *WORDS)
    hopeful = cut(dealt.groupBy("table", "sign", "p", "q").applyInArrow(_members(bits, cosine), "table int, sign long, p int, q int, own int, rep long"))
    whole = hopeful.join(made.select("rep", "copies", "v", "signs").hint("merge"), "rep")
    found = cut(whole.groupBy("table", "sign", "p", "q").applyInArrow(_links(bits, cosine), "rep long, n long, root long"))
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("root").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
    every = named.select("rep", "h", "g", "least", "copies").join(sums.hint("merge"), "rep", "left").join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    every = cut(every.select("rep", "h", "g", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root"))
    linked = every.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = spread_join(linked, least, ["root"], ["rep"]).select("h", "g", "n_links", "component_id").unionByName(every.where("root is null").select("h", "g", "n_links", F.col("least").alias("component_id")))
    for done in (made, large, hopeful, found):
        discard(done)
    sound_key = lambda c: F.when(F.col("v").isNotNull(), F.col(c)).alias(c)
    out = spread_join(keyed.select("vec_id", sound_key("h"), sound_key("g")), by_vector, ["h", "g"], ["vec_id"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

"""Exact top k by inner product: blocks of similar vectors, gone through best bound first, until no bound reaches the k-th score.

A block is a range of the vectors in an order that brings similar ones together; it
has the greatest and the least of each component (what a query can get from a term at
most) and its vectors as a forward index. Blocks lie in shards of SHARD blocks, whose
bounds come from the same maxima. Each query first searches the shard that it lies in,
which gives it a score to beat; then the FIRST shards with the best bounds, which raise
that score; then all others whose bound still reaches it. Equal vectors are one throughout, with the k + 1 least of their ids, as no other
of them can be among the k best of any query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import cut, discard, spread_join
from marginalia.llm.whitening import matrix, sound, whole

K, SCALE = 20, 64
#: Vectors of a block, blocks of a shard, partitions of the index at most (then they hold several shards).
BLOCK, SHARD, PARTITIONS = 64, 64, 10_000
#: Vectors drawn by hash that the order of all others goes by; it has no say in the result.
PIVOTS = 64
#: Shards that a query goes to before all others.
FIRST = 8
#: Queries that a shard takes at a time; queries, and shards, whose bounds a task works out at a time.
TOGETHER, QUERIES, SHARDS = 4096, 1024, 256
#: Components beyond this stand for themselves no longer.
MOST = 2**40
FAR = 2**63 - 1
INDEX = "kind int, shard long, dim int, low array<long>, top array<long>, x binary, vec array<long>, least array<long>, asked array<boolean>"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exactly; beyond a long, the least or greatest one."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object) if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -FAR, FAR).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The most that each query can score with a vector between ``low`` and ``top``: sums of what each term gives at most."""
    return products(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1), np.concatenate([top, low], axis=1))


def best_first(queries: np.ndarray, floor: np.ndarray, low: np.ndarray, top: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """``query, score, least, vec`` of the ``k`` best of each query that reach its ``floor``, and how many pairs were scored.

    ``blocks``: vectors, least ids and numbers of each. Of equal scores the lesser id is better.
    """
    bound = bounds(queries, low, top)
    order = np.argsort(-bound, axis=1, kind="stable")
    every, kth, scored = np.arange(len(queries)), floor.copy(), 0
    best = [np.zeros(0, np.int64) for _ in range(4)]
    for nth in range(len(blocks)):
        block = order[:, nth]
        live = bound[every, block] >= kth
        if not live.any():
            break  # bounds only fall from here, and scores to beat only rise
        new = []
        for b in np.unique(block[live]):
            who = np.flatnonzero(live & (block == b))
            x, least, vec = blocks[b]
            s = products(queries[who], x)
            scored += s.size
            reach = np.maximum(kth[who], np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]) if s.shape[1] > k else kth[who]
            q, d = np.nonzero(s >= reach[:, None])
            new.append((who[q], s[q, d], least[d], vec[d]))
        best = [np.concatenate([old, *parts]) for old, parts in zip(best, zip(*new, strict=True), strict=True)]
        by = np.lexsort((best[3], best[2], -best[1], best[0]))
        best = [c[by] for c in best]
        first = np.searchsorted(best[0], every)
        keep = np.arange(len(best[0])) - first[best[0]] < k
        best = [c[keep] for c in best]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) == k)
        kth[full] = np.maximum(kth[full], best[1][np.searchsorted(best[0], full) + k - 1])
    return *best, scored


def _order(pivots: dict[int, np.ndarray]):
    """Adds each vector's nearest pivot and how near it is; vectors of a length without a pivot have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            dims = t.column("dim").to_numpy()
            pivot, near = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d and int(d) in pivots:
                    x = matrix(t.column("x").take(pa.array(at)), np.float64)
                    cosine = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)) @ pivots[int(d)].T
                    pivot[at], near[at] = cosine.argmax(axis=1), cosine.max(axis=1)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(pivot), pa.array(near)], [*t.schema.names, "pivot", "near"])

    return work


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as rows of blocks (kind 0), and after each shard's last block one with its bounds (kind 1)."""
    part, made = TaskContext.get().partitionId() << 32, 0
    shard: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[pa.Table] = []

    def rows(kind: int, dim: int, low, top, x=None, t=None) -> pa.RecordBatch:
        lists = [[t.column(c).to_pylist()] if t is not None else [None] for c in ("vec", "least", "asked")]
        values = [[kind], [part + made], [dim], [low.tolist()], [top.tolist()], [None if x is None else x.tobytes()], *lists]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        names = ["kind", "shard", "dim", "low", "top", "x", "vec", "least", "asked"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    def ended(dim: int) -> Iterator[pa.RecordBatch]:
        nonlocal made
        if shard:
            yield rows(1, dim, np.min([a for a, _ in shard], axis=0), np.max([b for _, b in shard], axis=0))
            shard.clear()
            made += 1

    def block(t: pa.Table, dim: int) -> Iterator[pa.RecordBatch]:
        x = matrix(t.column("x").combine_chunks())
        low, top = x.min(axis=0), x.max(axis=0)
        shard.append((low, top))
        yield rows(0, dim, low, top, x, t)
        if len(shard) == SHARD:
            yield from ended(dim)

    dim = None
    for b in batches:
        t = pa.Table.from_batches([b])
        dims = b.column("dim").to_numpy()
        for own in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
            if not len(own):
                continue
            if dim is not None and dims[own[0]] != dim:
                if waiting:
                    yield from block(pa.concat_tables(waiting), dim)
                    waiting.clear()
                yield from ended(dim)
            dim = int(dims[own[0]])
            waiting.append(t.slice(own[0], len(own)))
            have = pa.concat_tables(waiting)
            while have.num_rows >= BLOCK:
                yield from block(have.slice(0, BLOCK), dim)
                have = have.slice(BLOCK)
            waiting[:] = [have] if have.num_rows else []
    if waiting:
        yield from block(pa.concat_tables(waiting), dim)
    yield from ended(dim)


def _opened(t: pa.Table):
    """Bounds and contents of the blocks of one shard."""
    low, top = matrix(t.column("low").combine_chunks()), matrix(t.column("top").combine_chunks())
    blocks = [
        (np.frombuffer(x, np.int64).reshape(len(vec), low.shape[1]), np.array(least, np.int64), np.array(vec, np.int64))
        for x, least, vec in zip(t.column("x").to_pylist(), t.column("least").to_pylist(), t.column("vec").to_pylist(), strict=True)
    ]
    return low, top, blocks


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def _at_home(k: int):
    def work(t: pa.Table) -> pa.Table:
        return _own(t, k)

    return work


def _own(t: pa.Table, k: int) -> pa.Table:
    """A shard's own queries over its blocks: each with its ``k`` best there, and the score to beat."""
    t = t.sort_by("vec0")
    low, top, blocks = _opened(t)
    asked = np.concatenate([np.array(a, bool) for a in t.column("asked").to_pylist()])
    q, vec = np.concatenate([b[0] for b in blocks])[asked], np.concatenate([b[2] for b in blocks])[asked]
    query, score, least, found, _ = best_first(q, np.full(len(q), -FAR), low, top, blocks, k)
    n = np.bincount(query, minlength=len(q))
    beat = np.full(len(q), -FAR)
    full = np.flatnonzero(n == k)
    beat[full] = score[np.searchsorted(query, full) + k - 1]
    dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
    return pa.table([
        pa.array(vec), pa.array(np.full(len(q), dim, np.int32)), pa.array(np.full(len(q), shard)), pa.array(beat), _lists(q, np.full(len(q), q.shape[1])), _lists(score, n), _lists(least, n), _lists(found, n),
    ], ["q", "dim", "home", "beat", "x", "score", "least", "vec"])


def _hopeful(queries: pa.Table, shards: pa.Table) -> pa.Table:
    """Pairs of a query and a shard, other than its own, whose bound reaches the score to beat."""
    out = []
    if queries.num_rows and shards.num_rows:
        dims, its, ids = queries.column("dim").to_numpy(), shards.column("dim").to_numpy(), shards.column("shard").to_numpy()
        home, beat = queries.column("home").to_numpy(), queries.column("beat").to_numpy()
        for d in np.intersect1d(dims, its):
            a, b = np.flatnonzero(dims == d), np.flatnonzero(its == d)
            of = lambda t, c, at: matrix(t.column(c).take(pa.array(at)).combine_chunks())
            low, top = of(shards, "low", b), of(shards, "top", b)
            for some in np.array_split(a, len(a) // 1024 + 1):
                most = bounds(of(queries, "x", some), low, top)
                reach = most >= beat[some][:, None]
                reach &= home[some][:, None] != ids[b][None, :]
                i, j = np.nonzero(reach)
                out.append(queries.select(["q", "beat", "x"]).take(pa.array(some[i])).append_column("shard", pa.array(ids[b[j]])).append_column("bound", pa.array(most[i, j])))
    names = {"q": pa.int64(), "beat": pa.int64(), "x": pa.list_(pa.int64()), "shard": pa.int64(), "bound": pa.int64()}
    return pa.concat_tables([t.cast(pa.schema(names.items())) for t in out]) if out else pa.schema(names.items()).empty_table()


def _away(k: int):
    """What a shard has to add to the queries that came to it."""
    names = ["q", "score", "least", "vec"]

    def work(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        query, *found, _ = best_first(matrix(queries.column("x").combine_chunks()), queries.column("beat").to_numpy(), *_opened(shard), k)
        return pa.table([pa.array(queries.column("q").to_numpy()[query]), *map(pa.array, found)], names)

    return work


def index(vectors: DataFrame) -> DataFrame:
    """Blocks and shards of ``vec, dim, x, least, asked``, one row each."""
    n = vectors.count()
    drawn = vectors.where("dim > 0").orderBy(F.xxhash64("vec", F.lit(1))).limit(PIVOTS).select("dim", "x").collect()  # a bounded number of vectors
    pivots: dict[int, list] = {}
    for r in drawn:
        pivots.setdefault(r["dim"], []).append(r["x"])
    unit = {d: (m := np.array(x, np.float64)) / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300) for d, x in pivots.items()}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    near = vectors.mapInArrow(_order(unit), f"{kinds}, pivot int, near double")
    order = ["dim", "pivot", "near", "vec"]
    ranged = near.repartitionByRange(max(1, min(PARTITIONS, -(-n // (BLOCK * SHARD)))), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_blocks, INDEX)


def _visited(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``q, score, least, vec``: what the shards of ``pairs`` (``q, beat, x, shard``) have that reaches the score to beat; a shard with many queries is dealt over tasks."""
    parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("parts"))
    going = spread_join(pairs.select("q", "beat", "x", "shard"), parts, ["shard"], ["q"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
    there = blocks.join(parts.hint("merge"), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return going.groupBy("shard", "part").cogroup(there.groupBy("shard", "part")).applyInArrow(_away(k), "q long, score long, least long, vec long")


def search(vectors: DataFrame, asked: Column, k: int = K, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row that ``asked`` (of its id, as ``vec_id``) marks; all, if there are fewer.

    Components count as floor(scale * component), within 2**40 either way; scores are
    their integer inner products, exact within a long and else its least or greatest.
    Ties go to the lesser id, null ids last. Ids are whole numbers; rows that repeat an id are rows
    of their own, and a query leaves out only its own row. Vectors that are null or hold null or
    non-finite components take no part; vectors of other lengths aren't compared. An
    empty table gives no rows. Other columns don't matter.
    """
    v = F.col(vector)
    plain = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where(sound(F.col("v"))).select("vec_id", whole(F.col("v"), scale, 0, MOST).alias("x"))
    rows = cut(plain.select("vec_id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"), F.coalesce(asked, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row")))
    key = ["h", "g"]  # two hashes stand for a vector
    first = Window.partitionBy(*key).orderBy(F.asc_nulls_last("vec_id"), "row")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    member = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")
    distinct = few.groupBy(*key).agg(F.first("x").alias("x"), F.sort_array(F.collect_list(member)).alias("members"))
    wanted = rows.where("asked").select(*key).distinct().withColumn("asked", F.lit(True))
    named = cut(distinct.join(wanted, key, "left").select(F.monotonically_increasing_id().alias("vec"), *key, "x", F.size("x").alias("dim"), F.coalesce("asked", F.lit(False)).alias("asked"), "members"))
    built = cut(index(named.select("vec", "dim", "x", F.coalesce(F.col("members")[0]["vec_id"], F.lit(FAR)).alias("least"), "asked")))
    blocks = built.where("kind = 0").drop("kind").withColumn("vec0", F.col("vec")[0])
    shards = built.where("kind = 1").select("shard", "dim", "low", "top")

    own = "q long, dim int, home long, beat long, x array<long>, score array<long>, least array<long>, vec array<long>"
    started = cut(blocks.groupBy("shard", "dim").applyInArrow(_at_home(k + 1), own))
    q_lots, s_lots = (max(1, -(-df.count() // some)) for df, some in ((started, QUERIES), (shards, SHARDS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = started.select("q", "dim", "home", "beat", "x", lot("q", q_lots).alias("a"), every(s_lots).alias("b"))
    right = shards.select("*", lot("shard", s_lots).alias("b"), every(q_lots).alias("a"))
    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_hopeful, "q long, beat long, x array<long>, shard long, bound long")
    pairs = cut(pairs.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "shard"))))
    here = started.select("q", F.explode(F.arrays_zip("score", "least", "vec")).alias("f")).select("q", "f.*")
    better = Window.partitionBy("q").orderBy(F.desc("score"), "least", "vec")
    best = lambda found: found.withColumn("nth", F.row_number().over(better)).where(F.col("nth") <= k + 1)
    near = cut(best(here.unionByName(_visited(pairs.where(F.col("nth") <= FIRST), blocks, k + 1))).drop("nth"))
    raised = near.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("beat"))
    late = pairs.where(F.col("nth") > FIRST).drop("beat").join(raised.hint("merge"), "q").withColumn("beat", F.coalesce("beat", F.lit(-FAR)))
    late = cut(late.where(F.col("bound") >= F.col("beat")))
    found = best(near.unionByName(_visited(late, blocks, k + 1))).select("q", "vec", "score")

    listed = spread_join(found, named.select("vec", "members"), ["vec"], ["q"]).select("q", "score", F.explode("members").alias("m"))
    last = Window.partitionBy("q").orderBy(F.desc("score"), "m.none", "m.vec_id", "m.row")
    ranked = listed.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= k + 1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("m.vec_id").alias("vec_id"), F.col("m.row").alias("row"), "score"))).alias("best"))
    by_key = cut(lists.join(named.select(F.col("vec").alias("q"), *key).hint("merge"), "q").drop("q"))
    for done in (built, started, pairs, near, late):
        discard(done)
    asking = spread_join(rows.where("asked").select(F.col("vec_id").alias("query_id"), "row", *key), by_key, key, ["row"])
    others = F.slice(F.filter("best", lambda m: m["row"] != F.col("row")), 1, k)
    out = asking.select("query_id", F.posexplode(others).alias("at", "m"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "m.vec_id", "m.score")

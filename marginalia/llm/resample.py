"""Documents drawn so that they look like a target: importance weights over hashed word runs, and Gumbel noise.

The words are read off the bytes of Arrow's UTF-8 buffers: a table of 256 entries folds
A-Z to lower case, another marks the bytes that belong to words (digits, letters, all of
a multi-byte character), and differences of the marks are the words' ends. The CRC of
all words advances a byte at a time for all of them at once, over a table; a run of
several words goes on from the register of the run that is one word shorter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import cut, discard
from marginalia.llm.packing import text_runs

BUCKETS, RUN, SHARE, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Bytes that all words advance by together; what is longer goes on by itself.
STEPS = 48
_START = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
#: Each byte in lower case (ASCII letters only), or 0 outside words.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word in the folded bytes ``data`` of texts that begin at ``offsets`` (one more than there are texts)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    joints = offsets[1:-1]
    joints = np.unique(joints[(joints > 0) & (joints < len(data))])
    joints = joints[(data[joints] != 0) & (data[joints - 1] != 0)]  # texts that meet inside a word
    if len(joints):
        starts, ends = np.sort(np.concatenate([starts, joints])), np.sort(np.concatenate([ends, joints]))
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def advance(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes from ``starts`` to ``ends``, a byte of each at a time."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, STEPS + 1).astype(np.int16), kind="stable")
    at, out = starts[order], register[order]
    live = np.cumsum(np.bincount(np.minimum(lengths, STEPS + 1), minlength=STEPS + 2)[::-1])[::-1]
    for p in range(STEPS):
        n = live[p + 1]
        if not n:
            break
        out[:n] = CRC[(out[:n] ^ data[at[:n] + p]) & 0xFF] ^ (out[:n] >> 8)
    for i in range(live[STEPS + 1]):
        rest = data[at[i] + STEPS : ends[order[i]]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: pa.Array, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and each text's words. Null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    data = FOLD[data]
    starts, ends, owner = word_bounds(data, offsets - offsets[0])
    words = np.bincount(owner, minlength=len(texts))
    found, owners = [], []
    register, first = np.full(len(starts), _START), np.arange(len(starts))
    for length in range(1, run + 1):
        if length > 1:
            whole = (first + length - 1 < len(starts)) & (owner[np.minimum(first + length - 1, len(starts) - 1)] == owner[first]) if len(starts) else np.zeros(0, bool)
            first, register = first[whole], register[whole]
            register = CRC[(register ^ np.uint32(0x20)) & 0xFF] ^ (register >> 8)
        last = first + length - 1
        register = advance(register, data, starts[last], ends[last])
        found.append((~register) % np.uint32(buckets))
        owners.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), words


def bucket_counts(rows: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``kind, bucket, n``: features of the texts of ``rows`` (``kind`` int, ``text``) by kind and bucket; each task hands on its sums only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for kinds, texts in text_runs(batches):
            bucket, owner, _ = features(texts, run, buckets)
            kind = kinds.to_numpy(zero_copy_only=False)
            for k in np.unique(kind):
                n = np.bincount(bucket[kind[owner] == k], minlength=buckets)
                sums[int(k)] = sums.get(int(k), 0) + n
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["kind", "bucket", "n"])

    return rows.select("kind", "text").mapInArrow(work, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: how much likelier the target makes it, one added to every count."""
    k = len(source)
    s, t = int(source.sum()) + k, int(target.sum()) + k
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * s) / float((int(a) + 1) * t))) for a, b in zip(source, target, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, run: int = RUN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_features, n_words, weight``: the floored mean gain of each document's features, 0 without any."""
    kind, buckets = docs.schema[id].dataType.simpleString(), len(gain)
    names = ["doc_id", "n_features", "n_words", "weight"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_runs(batches):
            bucket, owner, words = features(texts, run, buckets)
            n, total = np.bincount(owner, minlength=len(ids)), np.zeros(len(ids), np.int64)
            np.add.at(total, owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(words), pa.array(total // np.maximum(n, 1))], names)

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, n_features long, n_words long, weight long")


def noise(id: str = "doc_id", seed: int = SEED):
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` (``doc_id, n_features, n_words, weight, score``) with ``rank``, null for what isn't drawn.

    Scores are whole numbers within bounds that the buckets and 32 bits of noise set
    (some 110,000 at most), so their counts fit everywhere, and only documents at or
    above the last drawn score are sorted, score by score.
    """
    able = F.col("n_words") >= least_words
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = by_score.select("score", (F.sum("n").over(above) - F.col("n")).alias("base"), (F.floor(F.sum("n").over(Window.partitionBy()) * share / 100)).alias("most"))
    runs = cut(runs.where("base < most"))
    joined = scored.join(F.broadcast(runs), "score", "left")
    hopeful = able & F.col("base").isNotNull()
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = joined.where(~hopeful).select(*columns, F.lit(None).cast("long").alias("rank"))
    # equal rows are counted where they lie, so an id that fills the table doesn't meet in one task
    alike = joined.where(hopeful).groupBy(*columns, "base", "most", (F.spark_partition_id() % 64).alias("part")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("base") + F.sum("n").over(order)
    placed = alike.withColumn("last", last).select(*columns, "most", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("rank"))
    return placed.select(*columns, F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every document; ``share`` percent of those with ``least_words`` words are drawn.

    Features are runs of up to ``run`` words. The texts are read twice, once for the
    counts of all buckets and once for the weights; what goes through the driver are
    two counts a bucket. Null and empty texts have no features and weight 0; a null id
    has the noise of an empty one and comes last among ties; rows that repeat count each,
    and take ranks each. An empty table of documents gives no rows, an empty target
    equal gains but for the counts of the source. Other columns don't matter.
    """
    both = docs.select(F.lit(0).alias("kind"), F.col(text).alias("text")).union(target.select(F.lit(1), F.col(target_text)))
    counts = np.zeros((2, buckets), np.int64)
    for r in bucket_counts(both, run, buckets).collect():  # two a bucket at most
        counts[r.kind, r.bucket] = r.n
    scored = weights(docs, gains(*counts), run, id, text)
    scored = cut(scored.select("*", (F.col("weight") + noise(seed=seed)).alias("score")))
    return draw(scored, share, least_words)

"""Top k, whitening and resampling against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import resample, topk, whitening

NAN, INF = float("nan"), float("inf")
CLASHING = {"x": "1", "h": "2", "row": "3", "asked": "4", "members": "5", "n": "6", "dim": "7", "c": "8", "kind": "9", "score": "10", "rank": "11"}
KIND = "vec_id long, embedding array<float>"


def vectors(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def as_floats(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


# top k


def brute_topk(rows, k, asked):
    have = [(i, vid, [math.floor(64 * x) for x in v]) for i, (vid, v) in enumerate((a, as_floats(b)) for a, b in rows) if sound(v)]
    out = []
    for i, vid, q in have:
        if vid is not None and asked(vid):
            found = [(sum(a * b for a, b in zip(q, x, strict=True)), other) for j, other, x in have if j != i and len(x) == len(q)]
            found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
            out += [(vid, n + 1, other, s) for n, (s, other) in enumerate(found[:k])]
    return sorted(out, key=repr)


def topk_rows(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 8))
    rows = [(i, (centre[i % 6] / 3 + 0.02 * rng.standard_normal(8)).tolist()) for i in range(400)]
    rows += [(400 + i, centre[0].tolist()) for i in range(90)]  # copies, queries among them
    rows += [(500, None), (501, [NAN] * 8), (502, [1.0, None] + [0.0] * 6), (503, [INF] + [0.0] * 7), (504, [0.0] * 8), (505, []), (506, []), (507, [1.0, 2.0]), (520, [2.0, 1.0])]
    rows += [(None, centre[1].tolist()), (None, (centre[0] * 2).tolist()), (20, centre[2].tolist()), (20, centre[2].tolist()), (20, rows[20][1])]
    return rows


def test_topk_equals_brute_force(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SHARD", 4)
    for name, some in (("TOGETHER", 16), ("QUERIES", 7), ("SHARDS", 3), ("FIRST", 1)):
        monkeypatch.setattr(topk, name, some)
    df = vectors(spark, odd_vectors)
    assert topk_rows(topk.search(df, F.col("vec_id") % 20 == 0, k=5)) == brute_topk(odd_vectors, 5, lambda i: i % 20 == 0)


def test_topk_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [0.0, 0.0])]
    assert topk_rows(topk.search(vectors(spark, rows), F.col("vec_id") % 20 == 0)) == brute_topk(rows, 20, lambda i: i % 20 == 0)
    assert topk.search(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.search(vectors(spark, [(0, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_products_are_exact_or_the_end_of_a_long():
    big = np.array([[2**40, -(2**40)]])
    assert topk.products(np.array([[2**31, 3]]), np.array([[2**30, 5]]))[0, 0] == 2**61 + 15
    assert topk.products(big, big)[0, 0] == 2**63 - 1
    assert topk.products(big, -big)[0, 0] == -(2**63) + 1
    assert topk.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    centre = 20 * rng.standard_normal((16, 12))
    blocks = [(np.floor(c + rng.standard_normal((64, 12))).astype(np.int64), np.arange(64) + 64 * i, np.arange(64) + 64 * i) for i, c in enumerate(centre)]
    q = np.concatenate([b[0][:2] for b in blocks])
    low, top = np.array([b[0].min(axis=0) for b in blocks]), np.array([b[0].max(axis=0) for b in blocks])
    reach = topk.bounds(q, low, top)
    assert all((topk.products(q, b[0]).max(axis=1) <= reach[:, i]).all() for i, b in enumerate(blocks))
    *found, scored = topk.best_first(q, np.full(len(q), -topk.FAR), low, top, blocks, 5)
    s = topk.products(q, np.concatenate([b[0] for b in blocks]))
    want = [(i, s[i, j], j, j) for i in range(len(q)) for j in sorted(range(s.shape[1]), key=lambda j: (-s[i, j], j))[:5]]
    assert list(zip(*(c.tolist() for c in found), strict=True)) == want
    assert scored < s.size / 4


# whitening


def brute_whiten(rows, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in as_floats(v)] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, deviation, c @ v / np.sqrt(e), e / (c * c).sum() * n


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.standard_normal(40) * np.linspace(2, 0.3, 40) / 4).tolist()) for i in range(300)]
    df = vectors(spark, [*rows, (900, None), (901, [NAN] * 40), (902, [None] * 40), (903, [])])
    got = whitening.whiten(df).toPandas().sort_values(["component", "vec_id"])
    n, deviation, w, explained = brute_whiten(rows)
    assert len(got) == 300 * 32 and set(got.n) == {n}
    assert got.deviation[:300].tolist() == deviation.tolist()
    g = got.whitened.to_numpy().reshape(32, 300).T
    assert np.abs(g * np.sign((g * w).sum(axis=0)) - w).max() < 1e-7
    assert np.abs(got.explained.to_numpy().reshape(32, 300)[:, 0] - explained).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert np.abs(np.cov(g.T, bias=True) - np.eye(32)).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    none = whitening.whiten(vectors(spark, []))
    assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    line = [(None, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 1.0]), (7, [1.0]), (8, [3.0]), (9, [1.0])]
    got = whitening.whiten(vectors(spark, line)).collect()
    assert sorted((str(r.vec_id), r.component, r.n, round(abs(r.whitened), 6), round(r.explained, 6)) for r in got) == sorted(
        [("None", 1, 3, 1.224745, 1.0), ("1", 1, 3, 0.0, 1.0), ("1", 1, 3, 1.224745, 1.0), ("7", 1, 3, 0.707107, 1.0), ("8", 1, 3, 1.414214, 1.0), ("9", 1, 3, 0.707107, 1.0)]
    )
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None}


# resampling


def brute_resample(docs, target, run=1, buckets=10_000, share=10, least=20, seed=2024):
    def found(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    its, s, t = [(i, *found(x)) for i, x in docs], [0] * buckets, [0] * buckets
    for _, _, f in its:
        for b in f:
            s[b] += 1
    for x in target:
        for b in found(x)[1]:
            t[b] += 1
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log(float((b + 1) * big_s) / float((a + 1) * big_t))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, words, f in its:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): n + 1 for n, r in enumerate(able[: share * len(able) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


def resampled(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_docs():
    text = lambda i: " ".join(f"wörd{(i * j) % 37} Plain{j % 5}" for j in range(5 + i % 30))
    rows = [(i, text(i)) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \n.,;"), (303, "x" * 300_000), (304, "a" * 100 + " " + "b" * 48 + " " + "c" * 49), (305, "日本語 ÀÉ é\x00null"), (None, text(29)), (None, text(28))]
    return rows + [(7, text(7)), (29, text(29)), (29, text(29)), (29, text(5))]


@pytest.mark.parametrize("run", [1, 3])
def test_resampling_equals_brute_force(spark, odd_docs, run):
    df = spark.createDataFrame(odd_docs, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    target = ["wörd3 plain1 plain2 wörd3", None, "", "PLAIN4 wörd7 " * 40]
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run, share=35)
    assert resampled(got) == brute_resample(odd_docs, target, run=run, share=35)


def test_resampling_of_empty_tables(spark, odd_docs):
    kinds = "doc_id long, text string"
    none, some = spark.createDataFrame([], kinds), spark.createDataFrame(odd_docs, kinds)
    assert resample.resample(none, some).collect() == []
    assert resampled(resample.resample(some, none)) == brute_resample(odd_docs, [])


def test_texts_meet_inside_a_word():
    texts = pa.array(["ab", "", None, "cd ef", "gh"])
    bucket, owner, words = resample.features(texts, 2, 10_000)
    assert words.tolist() == [1, 0, 0, 2, 1]
    assert bucket.tolist() == [zlib.crc32(w) % 10_000 for w in (b"ab", b"cd", b"ef", b"gh", b"cd ef")]
    assert owner.tolist() == [0, 3, 3, 4, 3]
    assert resample.features(texts.slice(3), 1, 10_000)[1].tolist() == [0, 0, 1]

"""Searches over vectors and resampling against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajgraph.llm import hard_negatives, resampling, topk_search
from trajgraph.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, score string, n string, twin string, leaf string, v string"
CLASH = ("a", "b", "c", "d", "e")


@pytest.fixture(scope="module")
def vectors():
    """Clusters, repeated rows, ids with several vectors, and rows that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.15 * rng.normal(size=12)], int(i % 3)) for i in range(240)]
    rows += [rows[0]] * 3 + [rows[20]] * 9 + [(40, rows[7][1], 1), (60, rows[60][1], 2), (300, [0.0] * 12, 0), (320, [], 1), (340, [1.0, 2.0], 1), (-20, rows[3][1], 0)]
    odd = [(None, rows[1][1], 1), (100, None, 1), (120, [1.0, None], 1), (140, [float("nan")] * 12, 0), (160, [float("inf")] + [0.0] * 11, 0)]
    return rows, odd


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)


def scaled(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def test_topk_by_brute_force(spark, vectors):
    rows, odd = vectors
    own = scaled(rows, 64)
    want = []
    for q, (i, v, _) in enumerate(own):
        if i % 20 == 0:
            top = sorted(((-dot(v, w), j) for c, (j, w, _) in enumerate(own) if c != q))[:7]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(top)]
    got = topk_search.search(table(spark, rows + odd), 7, F.col("vec_id") % 20 == 0, 64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_in_many_blocks(spark, vectors, monkeypatch):
    rows, _ = vectors
    want = sorted(map(tuple, topk_search.search(table(spark, rows), 4, F.col("vec_id") % 3 == 0, 64).collect()))
    monkeypatch.setattr(topk_search, "SUPERBLOCK", 2)
    monkeypatch.setattr(topk_search, "CANDIDATES", 5)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    monkeypatch.setattr(V, "blocks_of", lambda n, *_: max(1, n // 30))
    assert sorted(map(tuple, topk_search.search(table(spark, rows), 4, F.col("vec_id") % 3 == 0, 64).collect())) == want


def test_topk_of_few_and_none(spark, vectors):
    rows, odd = vectors
    assert topk_search.search(table(spark, rows).limit(0), 5, F.col("vec_id") % 2 == 0, 64).collect() == []
    assert topk_search.search(table(spark, odd), 5, F.col("vec_id") % 2 == 0, 64).collect() == []
    assert topk_search.search(table(spark, rows[:1]), 5, F.lit(True), 64).collect() == []
    assert len(topk_search.search(table(spark, rows[:3]), 5, F.lit(True), 64).collect()) == 6


def test_postings_and_best():
    m = np.array([[0, 3], [2, 0], [0, -1]])
    start, row, weight = topk_search.postings(m)
    assert [list(zip(row[a:b].tolist(), weight[a:b].tolist(), strict=True)) for a, b in zip(start[:-1], start[1:], strict=True)] == [[(1, 2)], [(0, 3), (2, -1)]]
    scores = np.array([[5, 1], [5, 9], [5, 9], [7, np.iinfo(np.int64).min]])
    assert sorted(zip(*(x.tolist() for x in topk_search.best(scores, 2)), strict=True)) == [(0, 0), (1, 1), (2, 1), (3, 0)]
    dense = np.random.default_rng(0).integers(-3, 4, (40, 9))
    total = np.zeros((40, 40), dtype=dense.dtype)
    for q, c, s in topk_search.accumulate(dense, dense):
        total[c : c + len(s), q : q + s.shape[1]] = s
    assert (total == dense @ dense.T).all()


def hard(rows, scale, positives=5, negatives=5):
    own, out = scaled(rows, scale), []
    for q, (i, v, label) in enumerate(own):
        if i % 10:
            continue
        others = [(-dot(v, w), j, y) for c, (j, w, y) in enumerate(own) if c != q]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            window = sorted(x for x in others if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize(("leaf_rows", "block_rows"), [(4096, 1 << 15), (20, 7)])
def test_hard_negatives_by_brute_force(spark, vectors, leaf_rows, block_rows, monkeypatch):
    rows, odd = vectors
    monkeypatch.setattr(hard_negatives, "ROWS", 6)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    unlabelled = [(30, rows[1][1], None)]
    got = hard_negatives.mine(table(spark, rows + odd + unlabelled), F.col("vec_id") % 10 == 0, 256, leaf_rows=leaf_rows, block_rows=block_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == hard(rows, 256)


def test_hard_negatives_of_few_and_none(spark, vectors):
    rows, odd = vectors
    assert hard_negatives.mine(table(spark, rows).limit(0), F.lit(True), 256).collect() == []
    assert hard_negatives.mine(table(spark, odd), F.lit(True), 256).collect() == []
    assert hard_negatives.mine(table(spark, rows[:2]), F.lit(True), 256).collect() == []


def test_tree_eliminates_and_loses_nothing():
    """In clusters most leaves are dropped; a leaf that holds a row of the window never is. All rows are in leaves."""
    rng = np.random.default_rng(8)
    x = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 16)))).astype(np.int64)
    tree = hard_negatives.Tree(float((x * x).sum(1).max()))
    tree.grow(x[:4000], len(x), 200)
    leaf = tree.route(x, True)
    assert tree.leaves > 20 and np.bincount(leaf, minlength=tree.leaves).sum() == len(x)
    anchors = x[::50]
    scores = anchors @ x.T
    hi = np.sort(scores, axis=1)[:, -6]
    lo = -(-80 * hi // 100)
    alive = tree.survivors(anchors, lo[:, None], hi[:, None])
    for a in range(len(anchors)):
        assert alive[a][np.unique(leaf[(scores[a] >= lo[a]) & (scores[a] <= hi[a])])].all()
    assert alive.mean() < 0.5
    assert not tree.survivors(anchors, np.ones((len(anchors), 1)), np.zeros((len(anchors), 1))).any()


def test_equal_vectors_stay_one_leaf():
    tree = hard_negatives.Tree(4.0)
    tree.grow(np.ones((100, 4), dtype=np.int64), 10_000, 10)
    assert tree.leaves == 1 and (tree.route(np.ones((5, 4), dtype=np.int64)) == 0).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, most):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, most + 1) if i + k <= len(w)], len(w)


def resampled(docs, target, most, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *runs(t, most)) for i, t in docs]
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in runs(x, most)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, fs, words in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: len(able) * percent // 100])]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(drawn + [(*r, None) for r in left.elements()], key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = ["The", "fox", "né", "ünï", "ÉCOLE", "x9", "a", "b-c", "Don't", "日本語", "z" * 300, "of", "quartz"]
    own = [(i * 7 - 30, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 60, 150))]
    own += [own[3]] * 4 + [(12, own[5][1]), (12, "one  two"), (None, "word " * 30), (None, None), (1000, None), (1001, ""), (1002, " \t!?"), (2**40, "a b\x00c\x7fd " * 9000)]
    return own, ["the fox of quartz", None, "", "école 日本語 x9 x9"]


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 64, 60, 3), (3, 70_000, 100, 0)])
def test_resampling_by_brute_force(spark, texts, most, buckets, percent, least):
    own, target = texts
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in own], "doc_id long, text string, score string, n_features string").repartition(3)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, other, most, buckets, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(own, target, most, buckets, percent, least)


def test_resampling_of_none(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs.select("text")).collect() == []
    got = resampling.resample(docs, docs.select("text").limit(0)).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(texts[0], [], 1, 10_000, 10, 20)


def test_radix_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 1 << 33, 3000) >> 20, rng.integers(0, 5, 3000), strict=True)]
    got = resampling.radix_ranks(spark.createDataFrame(rows, "b long, a long").repartition(5), [("a", 4), ("b", 1 << 20)], block_rows=64).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 3001))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted((a, b) for b, a in rows)


def test_crc32_of_runs():
    texts = ["", "a", "The quick brown fox", "ünï " * 50, "x" * 70_000 + " y"]
    for most in (1, 2, 3):
        for text, got in zip(texts, resampling.bucket_lists(texts, most, 1 << 20), strict=True):
            assert got.tolist() == [zlib.crc32(f.encode()) % (1 << 20) for f in runs(text, most)[0]]

"""The corpus pipeline over the smallest tables, each stage on what the one before kept."""

import hashlib
import itertools
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from trajgraph.llm import langid, quality, toxicity
from trajgraph.llm.common import fold

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    seen = {"documents": docs}
    last = docs
    for name, stage in P.STAGES:
        out = stage(spark, last, DIR).cache()
        if name != "sharding":
            assert out.columns == docs.columns
        seen[name] = last = out
    known = seen["documents"].join(labels, "doc_id")
    kept = known.join(seen["quality"].select("doc_id"), "doc_id", "left_semi")
    assert kept.where("quality = 1").count() >= 0.95 * known.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.3 * known.where("quality = 0").count()
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in seen.items()}
    assert set(rows["near_dedup"]) == brute_representatives({i: r.text for i, r in rows["quality"].items()})
    items = [words10(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert set(rows["decontamination"]) == {i for i, r in rows["near_dedup"].items() if not brute_contaminated(words10(r.text), items)}
    # The mix: the words taken of each source come near its target, and no document comes more than twice.
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in rows["decontamination"].items()}
    source = {i: r.source for i, r in rows["decontamination"].items()}
    times = Counter(r.doc_id for r in seen["mixing"].collect())
    assert set(times) <= set(size) and max(times.values()) <= 2
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    have = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    goal, left = {}, set(names)
    while True:
        share = (1.5 * sum(have.values()) - sum(goal.values())) / sum(weight[s] for s in left) if left else 0
        full = {s for s in left if share * weight[s] >= 2 * have[s]}
        if not full:
            goal |= {s: share * weight[s] for s in left}
            break
        goal |= {s: 2.0 * have[s] for s in full}
        left -= full
    for s in names:
        took = sum(times[i] * size[i] for i in size if source[i] == s)
        assert abs(took - goal[s]) <= max(size[i] for i in size if source[i] == s)
    got = sorted((r.doc_id, r.shard) for r in seen["sharding"].collect())
    assert got == sorted((r.doc_id, brute_shard(r.doc_id)) for r in seen["mixing"].collect())


def words10(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute_contaminated(words, items):
    hit = set()
    for item in items:
        n = min(13, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def brute_representatives(texts):
    """The least id of each component of texts with a Jaccard similarity of 0.8 or more over five words."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {find(i) for i in sets}


def brute_shard(doc_id):
    """Regions of four shards in two racks: at each level the least exponential draw wins."""
    at, weight = "", {}
    for k in range(16):
        for path in (f"{k // 4}", f"{k // 4}.{k % 4 // 2}", f"{k // 4}.{k % 4 // 2}.{k}"):
            weight[path] = weight.get(path, 0) + 1

    def draw(path):
        u = (int(hashlib.md5(f"{doc_id}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weight[path]

    for depth in range(3):
        at = min((p for p in weight if p.count(".") == depth and p.startswith(at + "." if at else "")), key=draw)
    return int(at.rpartition(".")[2])


@pytest.fixture(scope="module")
def odd(spark):
    words = "the of and quick brown fox jumps over lazy dog while seven wizards boil jars from quartz mountain".split()
    long_ = " ".join(words[(7 * k) % 18] for k in range(20_000))
    rows = [(1, long_, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no id here", "de", "b"), (None, None, None, None), (4, "   ", "en", "b"), (5, long_, "en", "a"), (5, long_, "en", "a"), (6, "one two three", "fr", None), (6, "four five six", "fr", None)]
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("row", "score", "size", "key", "bin", "shard", "_spans", "node", "m", "copy", "y", "a.b")}).repartition(2)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, DIR)
    assert out.columns == odd.columns and out.count() >= 0
    assert stage(spark, odd.limit(0), DIR).count() == 0
    ids = sorted(r.doc_id or 0 for r in out.collect())
    if name == "near_dedup":
        assert ids == [0, 0, 1, 2, 3, 4, 6, 6]
    if name in ("decontamination", "sharding"):
        assert ids == sorted(r.doc_id or 0 for r in odd.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))

    def auc(got, label):
        m = got.where("held_out").join(labels, "doc_id").select("score", label).dropna().toPandas()
        rank, y = m["score"].rank().to_numpy(), m[label].to_numpy()
        return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))

    assert auc(quality.classify(docs, labels, fold(F.col("doc_id"), 5) == 0), "quality") > 0.95
    assert auc(toxicity.classify(docs, labels, fold(F.col("doc_id"), 3) == 1), "toxic") > 0.75
    lang = langid.identify(docs, fold(F.col("doc_id"), 4) == 2).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang["lang_pred"] == lang["lang"]).mean() > 0.98


def test_quality_scores_are_sums_of_bins():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row in x[:50]:
        z = model.intercept + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        z += sum(t[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])] for i, j, t in model.pairs)
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-z)))

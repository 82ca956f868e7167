"""Forms for groups that fit no task, at lowered bounds: ranks, quantiles, nearest lines, reports, appended splits, stored results."""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajgraph.functions import ranks
from trajgraph.operators import neighbors as N
from trajgraph.operators import stats as R
from trajgraph.sources import sinks
from trajgraph.streaming import append


@pytest.fixture(params=[1_000_000, 0], ids=["window", "ranges"])
def bound(request, monkeypatch):
    monkeypatch.setattr(ranks, "IN_ONE_TASK", request.param)


def test_row_numbers_and_running_sums(spark, bound):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(x), i, int(a)) for i, (k, x, a) in enumerate(zip(rng.choice(3, 400, p=[0.9, 0.08, 0.02]), rng.integers(0, 30, 400), rng.integers(0, 5, 400), strict=True))]
    df = spark.createDataFrame(rows, "k int, x int, id int, a int").repartition(5)
    want = {}
    for k in range(3):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want[r[2]] = (n, total)
            total += r[3]
    got = ranks.row_numbers(df, ["k"], ["x", "id"], "n")
    assert {r.id: r.n for r in got.collect()} == {i: v[0] for i, v in want.items()}
    sums = ranks.running_sums(df, ["k"], ["x", "id"], F.col("a"), "s")
    assert {r.id: r.s for r in sums.collect()} == {i: v[1] for i, v in want.items()}
    assert ranks.row_numbers(df.limit(0), ["k"], ["x", "id"], "n").collect() == []


def test_quantiles(spark, bound):
    rng = np.random.default_rng(2)
    data = {k: np.round(rng.normal(size=n), 1) for k, n in ((0, 1), (1, 2), (2, 301))}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [(2, None), (3, None)], "k int, x double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(df, ["k"], "x", shares).collect()}
    assert got.keys() == data.keys() and all(np.allclose(got[k], np.quantile(v, shares)) for k, v in data.items())
    whole = ranks.quantiles(df, [], "x", shares).first().q
    assert np.allclose(whole, np.quantile(np.concatenate(list(data.values())), shares))


def test_signed_ranks_by_enumeration(spark, bound):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y)) for k in range(3) for x, y in rng.integers(0, 6, (40, 2))]
    got = {r.k: r for r in R.wilcoxon(spark.createDataFrame(rows, "k int, x double, y double"), "x", "y", ["k"]).collect()}
    for k in range(3):
        d = [x - y for g, x, y in rows if g == k and x != y]
        rank = [sum(abs(b) < abs(a) for b in d) + (sum(abs(b) == abs(a) for b in d) + 1) / 2 for a in d]
        assert got[k].n == len(d) and got[k].w_plus == sum(r for r, a in zip(rank, d, strict=True) if a > 0) and got[k].w_minus == sum(r for r, a in zip(rank, d, strict=True) if a < 0)
        assert got[k].ties == sum(sum(abs(b) == abs(a) for b in d) ** 2 - 1 for a in d)


POINT = "array<struct<r double, a double, s double>>"


def lines_of(rng, n, centres):
    """Lines of four points in bundles, half of them reversed, a few twice."""
    out = []
    for i in range(n):
        v = centres[i % len(centres)] + 0.1 * rng.normal(size=(4, 3))
        out.append(v[::-1] if i % 2 else v)
    return [*out[: n - 3], out[0], out[1], out[1]]


def by_brute_force(lines, k, chosen=None, flip=True):
    want = {}
    for x, a in lines.items():
        found = []
        for y, b in lines.items():
            if chosen is None or y in chosen:
                d, e = np.linalg.norm(a - b) / 15, np.linalg.norm(a - b[::-1]) / 15
                found.append((round(min(d, e) if flip else d, 9), y))
        want[x] = [y for _, y in sorted(found)[:k]]
    return want


@pytest.mark.parametrize("flip", [True, False])
def test_nearest_lines_by_an_index(spark, monkeypatch, flip):
    """Blocks of 12 lines: all neighbours as by brute force, from few pairs of blocks."""
    monkeypatch.setattr(N, "BLOCK_LINES", 12)
    rng = np.random.default_rng(5)
    lines = dict(enumerate(lines_of(rng, 300, 20 * rng.normal(size=(12, 4, 3)))))
    rows = [("s", i, [tuple(map(float, p)) for p in v]) for i, v in lines.items()] + [("t", i, [tuple(map(float, p)) for p in lines[i]]) for i in range(5)]
    df = spark.createDataFrame(rows, f"subject string, id int, points {POINT}")
    kept_pairs = []
    plain = N.near_blocks
    monkeypatch.setattr(N, "near_blocks", lambda *a: kept_pairs.append((a[0].select("subject", "_part").distinct().count(), (p := plain(*a)).count())) or p)
    got = {}
    for r in N.knn(df, ["subject"], "id", "points", 4, flip=flip).collect():
        got.setdefault((r.subject, r.id), {})[r["rank"]] = r.neighbour
    want = by_brute_force(lines, 4, flip=flip)
    assert all([got["s", i][q + 1] for q in range(4)] == want[i] for i in lines)
    few = by_brute_force({i: lines[i] for i in range(5)}, 4, flip=flip)
    assert all([got["t", i][q + 1] for q in range(4)] == few[i] for i in range(5))
    blocks, pairs = kept_pairs[0]
    assert blocks > 20 and pairs < 0.6 * blocks * (blocks - 1)


def test_nearest_of_chosen_lines_by_an_index(spark, monkeypatch):
    """Blocks without candidates, fewer candidates than neighbours asked for, one block of equal lines."""
    monkeypatch.setattr(N, "BLOCK_LINES", 10)
    rng = np.random.default_rng(6)
    lines = dict(enumerate(lines_of(rng, 80, 5 * rng.normal(size=(5, 4, 3)))))
    lines |= {i: lines[0] for i in range(200, 240)}
    df = spark.createDataFrame([(1, i, [tuple(map(float, p)) for p in v]) for i, v in lines.items()], f"subject int, id int, points {POINT}")
    for chosen in ([3, 9, 200, 201, 41], [7, 8]):
        got = {}
        for r in N.knn(df, ["subject"], "id", "points", 4, df.where(F.col("id").isin(chosen))).collect():
            got.setdefault(r.id, {})[r["rank"]] = r.neighbour
        want = by_brute_force(lines, 4, set(chosen))
        assert all([got[i][q + 1] for q in range(len(want[i]))] == want[i] and len(got[i]) == len(want[i]) for i in lines)
    assert N.knn(df.limit(0), ["subject"], "id", "points", 4).collect() == []


def test_reports_in_parts(spark, tmp_path):
    rows = [("a", i % 50, float(i)) for i in range(300)] + [("a", 3, 3.0), ("b", None, float("nan")), ("c", 1, 2.5)]
    df = spark.createDataFrame(rows, "k string, s int, x double").repartition(6)
    sinks.write_reports(df, ["k"], ["s", "x"], ["x"], str(tmp_path / "r"))
    whole = {r.k: json.loads(r.json) for r in sinks.report(df, ["k"], ["s", "x"], ["x"]).collect()}
    for k in "abc":
        files = sorted((tmp_path / "r" / f"k={k}").glob("part-*"))
        got = json.loads("".join(f.read_text() for f in files))
        assert got["n"] == whole[k]["n"] and got["summary"]["x"]["count"] == whole[k]["summary"]["x"]["count"]
        assert [{c: v for c, v in r.items() if v is not None} for r in got["records"]] == whole[k]["records"]
        assert all(math.isclose(v, got["summary"]["x"][c]) for c, v in whole[k]["summary"]["x"].items())
    assert len(list((tmp_path / "r" / "k=a").glob("part-*"))) > 1


SHAPE = "subject_id int, x int"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(folder)


def test_a_batch_stopped_before_its_commit_doubles_nothing(spark, tmp_path, monkeypatch):
    at = {c: str(tmp_path / c) for c in ("in", "out", "state")}
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "subject_id int, split string")
    shape = spark.createDataFrame([], SHAPE).schema
    go = lambda: append.append_stream(spark, at["in"], shape, splits, "subject_id", at["out"], at["state"])
    arrive(spark, at["in"], [(1, 1), (2, 2), (1, 3)])
    go()
    arrive(spark, at["in"], [(1, 4), (2, 5)])
    plain = append.commit

    def stopped(*_):
        raise KeyError("stopped between write and commit")

    monkeypatch.setattr(append, "commit", stopped)
    with pytest.raises(Exception, match="stopped"):
        go()
    assert sorted(r.x for r in append.read_splits(spark, at["out"]).collect()) == [1, 2, 3]
    monkeypatch.setattr(append, "commit", plain)
    go()
    go()
    assert sorted((r.split, r.x) for r in append.read_splits(spark, at["out"]).collect()) == [("test", 2), ("test", 5), ("train", 1), ("train", 3), ("train", 4)]
    # The same batch again, as after a stop between its commit and that of the stream.
    last = append.manifest(spark, at["out"])[-1]
    append.take(spark.createDataFrame([(1, 4)], SHAPE).withColumn("_label", F.lit(False)), last.number, last.stream, splits, "subject_id", at["out"], False)
    assert append.read_splits(spark, at["out"]).count() == 5


def test_subjects_wait_until_their_counts_agree(spark, tmp_path):
    at = {c: str(tmp_path / c) for c in ("in", "labels", "out", "state")}
    splits = spark.createDataFrame([(i, "train") for i in range(5)], "subject_id int, split string")
    shape = spark.createDataFrame([], SHAPE).schema
    go = lambda: append.append_stream(spark, at["in"], shape, splits, "subject_id", at["out"], at["state"], at["labels"], shape)
    there = lambda: sorted(r.x for r in append.read_splits(spark, at["out"]).collect()) if any(b.released for b in append.manifest(spark, at["out"])) else []
    arrive(spark, at["in"], [(1, 10), (1, 11), (2, 20), (3, 30)])
    arrive(spark, at["labels"], [(1, 0), (3, 0), (3, 0)])
    go()
    assert there() == []
    arrive(spark, at["in"], [(4, 40)])
    arrive(spark, at["labels"], [(1, 0), (4, 0)])
    go()
    assert there() == [10, 11, 40]  # 1 waited for its second label; 2 has none, 3 one too many
    arrive(spark, at["in"], [(3, 31), (1, 12)])
    go()
    assert there() == [10, 11, 30, 31, 40]  # 1 has a row too many again
    arrive(spark, at["labels"], [(1, 0)])
    go()
    assert there() == [10, 11, 12, 30, 31, 40]


def test_stored_results_are_trusted_by_their_record(spark, tmp_path):
    source, path, runs = str(tmp_path / "source"), str(tmp_path / "cache"), []
    spark.range(3).write.parquet(source)

    def compute(extra=False):
        runs.append(1)
        df = spark.read.parquet(source)
        return df.withColumn("more", F.lit(1)) if extra else df

    get = lambda **more: sinks.load_or_compute(spark, path, compute, inputs=[source], **more).count()
    assert get() == 3
    stamp = sorted(os.listdir(f"{path}/data"))
    assert get() == 3 and sorted(os.listdir(f"{path}/data")) == stamp  # read again
    assert get(force=True) == 3 and sorted(os.listdir(f"{path}/data")) != stamp
    spark.range(4).write.mode("append").parquet(source)
    assert get() == 7  # other inputs
    assert sinks.load_or_compute(spark, path, lambda: compute(True), inputs=[source]).columns == ["id", "more"]  # another schema
    assert get() == 7
    for name in os.listdir(path):
        if name.startswith(("commit", ".commit")):
            os.remove(f"{path}/{name}")
    stamp = sorted(os.listdir(f"{path}/data"))
    assert get() == 7 and sorted(os.listdir(f"{path}/data")) != stamp  # a folder without a record isn't trusted

import numpy as np
from pyspark.sql import functions as F

from trajgraph.functions import polyline as P


def lines(spark, sizes):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(n, [tuple(map(float, p)) for p in rng.normal(size=(n, 3))]) for n in sizes], "n int, points array<struct<r:double,a:double,s:double>>")


def test_resample_against_numpy(spark):
    df = lines(spark, [2, 3, 15, 100])
    for decay in (0.0, 2.0):
        for r in df.select("points", P.resample(F.col("points"), 15, decay).alias("x")).collect():
            p = np.array(r.points)
            at = np.array(P.fractions(15, decay)) * (len(p) - 1)
            lo, hi = np.minimum(np.floor(at), len(p) - 1).astype(int), np.minimum(np.ceil(at), len(p) - 1).astype(int)
            want = p[lo] + (at - np.floor(at))[:, None] * (p[hi] - p[lo])
            assert np.allclose(np.array(r.x), want)


def test_length_and_floor(spark):
    for r in lines(spark, [1, 2, 40]).select("points", P.length(F.col("points")).alias("l"), P.resample_floor(F.col("points"), 5).alias("f")).collect():
        p = np.array(r.points)
        assert np.isclose(r.l, np.linalg.norm(np.diff(p, axis=0), axis=1).sum())
        assert np.allclose(np.array(r.f), p[[k * (len(p) - 1) // 4 for k in range(5)]])


def test_mdf_properties(spark):
    df = lines(spark, [15, 15]).crossJoin(lines(spark, [15]).withColumnRenamed("points", "y").drop("n"))
    x, y = F.col("points"), F.col("y")
    for r in df.select(P.mdf(x, x).alias("same"), P.mdf(x, F.reverse(x)).alias("turned"), P.mdf(x, y).alias("a"), P.mdf(x, F.reverse(y)).alias("b")).collect():
        assert r.same.dist == 0 and r.same.flip == 0
        assert np.isclose(r.turned.dist, 0) and r.turned.flip == 1
        assert np.isclose(r.a.dist, r.b.dist)

"""Similarity of graphs across subjects and sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajgraph.functions.ranks import largest_group
from trajgraph.functions.tables import kept
from trajgraph.operators import compare
from trajgraph.operators.compare import EPS, cells, guarded


#: Subjects of a block: two blocks of graphs of 13,530 cells are some 50 MB.
BLOCK = 256


def vectors(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, z): the z-scores of each graph over its dense triangle (EPS added to the deviation), over the root of the number of cells:
    the dot product of two is their correlation."""
    k = cells(n)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n))
        a[pdf["i"].to_numpy() - 1, pdf["j"].to_numpy() - 1] = pdf["w"]
        v = a[np.triu_indices(n)]
        z = (v - v.mean()) / (v.std() + EPS) / np.sqrt(k)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in keys} | {"z": [z]})

    shape = T.StructType([*[e.schema[c] for c in keys], T.StructField("z", T.ArrayType(T.DoubleType()))])
    return e.select(*keys, "i", "j", "w").groupBy(*keys).applyInPandas(work, shape)


def pair_sums(x: DataFrame, y: DataFrame, group: list[str], subject: str, column: str, measure: str, each: bool) -> DataFrame:
    """Sums over pairs of subjects: (group, subject, total, squares, k) of each subject of x with all other subjects of y, or, without
    `each`, (group, total, squares, k) of all unordered pairs of x (which is y then). measure: dot product or distance of the vectors.

    Subjects are dealt to blocks; a task holds one block of each side, makes one matrix product and adds up what it made: a row a
    subject (or one row) leaves it, never a pair.
    """
    blocks = -(-max(largest_group(s, group) for s in ((x,) if x is y else (x, y))) // BLOCK) or 1
    block = F.pmod(F.xxhash64(subject), F.lit(blocks)).cast("int")
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    first, last = F.lit(0), F.lit(blocks - 1)
    left = x.select(*group, F.col(subject).alias("id"), F.col(column).alias("v"), block.alias("_p"), every(first if each else block, last).alias("_q"))
    # Named anew, as both sides may be one table.
    right = y.select(*[F.col(g).alias(g) for g in group], F.col(subject).alias("id"), F.col(column).alias("v"), every(first, last if each else block).alias("_p"), block.alias("_q"))
    id_ = [T.StructField(subject, x.schema[subject].dataType)] if each else []
    shape = T.StructType([*[x.schema[g] for g in group], *id_, *[T.StructField(c, T.DoubleType()) for c in ("total", "squares")], T.StructField("k", T.LongType())])

    def add_up(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=shape.names)
        m, w, a, b = np.vstack(p["v"]), np.vstack(q["v"]), p["id"].to_numpy(), q["id"].to_numpy()
        value = m @ w.T
        if measure == "distance":
            value = np.sqrt(np.maximum((m * m).sum(1)[:, None] + (w * w).sum(1)[None, :] - 2 * value, 0.0))
        # Of two blocks all pairs count once, of a block with itself half of them.
        count = (a[:, None] != b[None, :]) if each or key[-2] != key[-1] else a[:, None] < b[None, :]
        value = np.where(count, value, 0.0)
        sums = [value.sum(1), (value * value).sum(1), count.sum(1)]
        if not each:
            sums = [[v.sum()] for v in sums]
        return pd.DataFrame({g: np.full(len(sums[0]), key[i], dtype=object) for i, g in enumerate(group)} | ({subject: a} if each else {}) | dict(zip(("total", "squares", "k"), sums, strict=True)))

    on = [*group, "_p", "_q"]
    parts = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(add_up, shape)
    return parts.groupBy(*group, *([subject] if each else [])).agg(*[F.sum(c).alias(c) for c in ("total", "squares", "k")])


def spread_of_pairs(sums: DataFrame, group: list[str], mean: str, std: str) -> DataFrame:
    """Mean, population deviation and number of pairs from their sums."""
    m = F.col("total") / F.col("k")
    return sums.where(F.col("k") > 0).select(*group, m.alias(mean), F.sqrt(F.greatest(F.col("squares") / F.col("k") - m * m, F.lit(0.0))).alias(std), F.col("k").alias("n_pairs"))


def intra_similarity(b: DataFrame, group: list[str], subject: str, n: int) -> DataFrame:
    """(group, subject, value): the correlation of both sides (t, p) of each subject."""
    return compare.pearson_z(b, [*group, subject], n).withColumnRenamed("r", "value")


def intra_lerm(logs: DataFrame, group: list[str], subject: str, versions: tuple[str, str] = ("true", "pred"), column: str = "version") -> DataFrame:
    """(group, subject, value): log-Euclidean distance of two versions; null where one has no logarithm. logs: log_vectors."""
    keys = [*group, subject]
    x, y = (logs.where(F.col(column) == v).select(*keys, F.col("log").alias(name)) for v, name in zip(versions, ("x", "y"), strict=True))
    return logs.select(*keys).distinct().join(x, keys, "left").join(y, keys, "left").select(*keys, compare.distance(F.col("x"), F.col("y")).alias("value"))


def inter_similarity(true: DataFrame, pred: DataFrame, group: list[str], subject: str, n: int) -> DataFrame:
    """Mean over the other subjects' true graphs for each predicted one; a lone subject has none."""
    on = [*group, subject, "i", "j"]
    tagged = lambda e, t, p: e.select(*on, t.alias("t"), p.alias("p"))
    both = tagged(true, F.col("w"), F.lit(0.0)).unionByName(tagged(pred, F.lit(0.0), F.col("w")))
    return inter_of_both(both.groupBy(*on).agg(F.sum("t").alias("t"), F.sum("p").alias("p")), group, subject, n)


def inter_of_both(b: DataFrame, group: list[str], subject: str, n: int) -> DataFrame:
    """(group, subject, value): mean correlation of each predicted graph (p) with the other subjects' true ones (t); a lone subject has none.

    A correlation is (sum of products / cells - product of means) / product of deviations, so its sum over all true graphs needs only
    the sum of their cells over their deviations, and that of their means; the subject's own is taken off again. No pair is made.
    """
    keys, k = [*group, subject], cells(n)
    dev = lambda s, q: F.sqrt(F.greatest(F.col(q) / k - F.pow(F.col(s) / k, 2), F.lit(0.0))) + EPS
    own = b.groupBy(*keys).agg(*compare.sums(), F.max((F.col("t") != 0).cast("int")).alias("has_t"), F.max((F.col("p") != 0).cast("int")).alias("has_p"))
    own = own.select(*keys, (F.col("sx") / k).alias("mt"), (F.col("sy") / k).alias("mp"), dev("sx", "sxx").alias("dt"), dev("sy", "syy").alias("dp"), "sxy", "has_t", "has_p")
    true = b.where(F.col("t") != 0).join(own.select(*keys, "dt"), keys).groupBy(*group, "i", "j").agg(F.sum(F.col("t") / F.col("dt")).alias("all_t"))
    of = own.where("has_t = 1").groupBy(*group).agg(F.sum(F.col("mt") / F.col("dt")).alias("all_m"), F.count(F.lit(1)).alias("k_t"))
    product = b.where(F.col("p") != 0).join(true, [*group, "i", "j"]).groupBy(*keys).agg(F.sum(F.col("p") * F.col("all_t")).alias("product"))
    s = own.where("has_p = 1").join(of, group).join(product, keys, "left")
    total = (F.coalesce("product", F.lit(0.0)) / k - F.col("mp") * F.col("all_m")) / F.col("dp")
    itself = F.when(F.col("has_t") == 1, (F.col("sxy") / k - F.col("mp") * F.col("mt")) / (F.col("dp") * F.col("dt"))).otherwise(0.0)
    others = F.col("k_t") - F.col("has_t")
    return s.where(others > 0).select(*keys, ((total - itself) / others).alias("value"))


def inter_lerm(logs: DataFrame, group: list[str], subject: str, subjects: DataFrame | None = None) -> DataFrame:
    """(group, subject, value, left_out): mean log-Euclidean distance of each predicted graph to the other subjects' true ones.

    A graph without a logarithm has no distance; it is left out of the means and counted: left_out is the number of other subjects
    without one, of those in `subjects` (group, subject; by default only those in logs, of which none is left out).
    """
    side = lambda v: logs.where(F.col("version") == v).drop("version")
    sums = pair_sums(side("pred"), side("true"), group, subject, "log", "distance", True).where(F.col("k") > 0)
    if subjects is None:
        return sums.select(*group, subject, (F.col("total") / F.col("k")).alias("value"), F.lit(0).cast("long").alias("left_out"))
    all_ = subjects.select(*group, subject).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("all"))
    return sums.join(all_, group).select(*group, subject, (F.col("total") / F.col("k")).alias("value"), (F.col("all") - 1 - F.col("k")).alias("left_out"))


def with_population(b: DataFrame, group: list[str], subject: str) -> DataFrame:
    """(group, subject, i, j, t, p, pop): cells of either side or of the mean true graph of the group's subjects, absent ones 0."""
    keys = [*group, subject]
    n = b.where(F.col("t") != 0).groupBy(*group).agg(F.countDistinct(subject).alias("n_subjects"))
    mean = b.where(F.col("t") != 0).groupBy(*group, "i", "j").agg(F.sum("t").alias("s")).join(n, group).select(*group, "i", "j", (F.col("s") / F.col("n_subjects")).alias("pop"))
    target = b.select(*keys).distinct().join(mean, group)
    zero = F.lit(0.0)
    all_ = b.select(*keys, "i", "j", "t", "p", zero.alias("pop")).unionByName(target.select(*keys, "i", "j", zero.alias("t"), zero.alias("p"), "pop"))
    return all_.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("t", "p", "pop")])


def group_similarity(b: DataFrame, group: list[str], subject: str, n: int) -> DataFrame:
    """Each predicted graph against the mean true graph of its group; null where there is none."""
    keys = [*group, subject]
    wide = with_population(b, group, subject)
    both = wide.select(*keys, "i", "j", F.col("pop").alias("t"), "p")
    got = compare.pearson_z(compare.for_both(both, keys), keys, n).withColumnRenamed("r", "value")
    return b.where(F.col("p") != 0).select(*keys).distinct().join(got, keys, "left")


def population_logs(b: DataFrame, group: list[str], subject: str, n: int, imaginary: bool = False) -> DataFrame:
    """(group, log) of the mean true graph of each group; imaginary: as in log_vectors."""
    subjects = b.where(F.col("t") != 0).groupBy(*group).agg(F.countDistinct(subject).alias("k"))
    mean = b.where(F.col("t") != 0).groupBy(*group, "i", "j").agg(F.sum("t").alias("s")).join(subjects, group).select(*group, "i", "j", (F.col("s") / F.col("k")).alias("w"))
    return compare.log_vectors(mean, group, n, imaginary=imaginary)


def group_lerm(logs: DataFrame, population: DataFrame, group: list[str], subject: str, version: str = "pred") -> DataFrame:
    """(group, subject, value): log-Euclidean distance of each graph of a version to the mean one; null where one has no logarithm."""
    own = logs.where(F.col("version") == version)
    return own.join(population.withColumnRenamed("log", "pop"), group, "left").select(*group, subject, compare.distance(F.col("log"), F.col("pop")).alias("value"))


def similarity_table(intra: DataFrame, inter: DataFrame, group: DataFrame) -> DataFrame:
    tag = lambda df, name: df.withColumn("comparison_type", F.lit(name))
    return tag(intra, "Intrasubject").unionByName(tag(inter, "Intersubject")).unionByName(tag(group, "Group-average"))


def trt_similarity(e: DataFrame, keys: list[str], n: int, session: str = "session") -> DataFrame:
    """Test against retest for each key, where both are present."""
    return compare.pearson_z(compare.paired(e, keys, session, "test", "retest"), keys, n)


def intersubject_within(e: DataFrame, group: list[str], subject: str, n: int) -> DataFrame:
    """Mean, population deviation and number of the similarities of all unordered pairs of subjects of a group."""
    v = kept(vectors(e, [*group, subject], n))  # read as both sides
    return spread_of_pairs(pair_sums(v, v, group, subject, "z", "dot", False), group, "mean_r", "std_r")


def intersubject_lerm(logs: DataFrame, group: list[str], subject: str) -> DataFrame:
    """The same of the log-Euclidean distances of graphs that have a logarithm."""
    return spread_of_pairs(pair_sums(logs, logs, group, subject, "log", "distance", False), group, "mean_lerm", "std_lerm")


def trt_vs_intersubject(trt: DataFrame, inter: DataFrame, keys: list[str]) -> DataFrame:
    own = trt.groupBy(*keys).agg(F.avg("r").alias("trt_mean"), F.count("r").alias("n_subjects"))
    return own.join(inter.groupBy(*keys).agg(F.avg("mean_r").alias("inter_mean")), keys)


def test_vs_population(b: DataFrame, group: list[str], subject: str, n: int) -> DataFrame:
    """(group, subject, comparison, r, rmse, mae, n_a, n_b) for pred-pop, true-pop and pred-true: one aggregation of the cells with the
    three values side by side. A comparison needs an edge on both of its sides."""
    keys = [*group, subject]
    k = n * (n - 1)
    aggs, out = [], []
    for name, x, y in (("pred-pop", "p", "pop"), ("true-pop", "t", "pop"), ("pred-true", "p", "t")):
        a, c, at = F.col(x), F.col(y), name.replace("-", "_")
        nz, off = (a != 0) & (c != 0), F.col("i") != F.col("j")
        v = lambda e, nz=nz: F.sum(F.when(nz, e).otherwise(0.0))
        d = F.when(off, a - c).otherwise(0.0)
        sums_ = {"k": F.sum(nz.cast("int")), "sx": v(a), "sy": v(c), "sxx": v(a * a), "syy": v(c * c), "sxy": v(a * c), "dd": F.sum(2 * d * d), "ad": F.sum(2 * F.abs(d)), "n_a": F.sum((a != 0).cast("int")), "n_b": F.sum((c != 0).cast("int"))}
        aggs += [e.alias(f"{at}_{s}") for s, e in sums_.items()]
        col = lambda s, at=at: F.col(f"{at}_{s}")
        out.append(F.struct(F.lit(name).alias("comparison"), guarded(*[col(s) for s in ("k", "sx", "sy", "sxx", "syy", "sxy")]).alias("r"), F.sqrt(col("dd") / k).alias("rmse"), (col("ad") / k).alias("mae"), col("n_a").alias("n_a"), col("n_b").alias("n_b")))
    s = with_population(b, group, subject).groupBy(*keys).agg(*aggs)
    return s.select(*keys, F.explode(F.array(*out)).alias("x")).select(*keys, "x.*").where((F.col("n_a") > 0) & (F.col("n_b") > 0))


def test_vs_population_lerm(logs: DataFrame, population: DataFrame, group: list[str], subject: str) -> DataFrame:
    """(group, subject, comparison, lerm) of the same three comparisons, for graphs that have a logarithm; with the imaginary parts in
    the vectors it is the complex distance."""
    tag = lambda df, name: df.withColumnRenamed("value", "lerm").withColumn("comparison", F.lit(name))
    parts = [tag(group_lerm(logs, population, group, subject, v), f"{v}-pop") for v in ("pred", "true")] + [tag(intra_lerm(logs, group, subject), "pred-true")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def three_way_long(x8: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, comparison, metric, value), nulls dropped."""
    return x8.unpivot([*keys, "comparison"], ["r", "rmse", "mae"], "metric", "value").where(F.col("value").isNotNull())


def metric_similarity(long_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, metric, value) -> true and pred values, differences, and 1 - relative difference."""
    side = lambda v: long_.where(F.col("version") == v).select(*keys, "metric", F.col("value").alias(f"{v}_value"))
    both = side("true").join(side("pred"), [*keys, "metric"])
    d = F.abs(F.col("true_value") - F.col("pred_value"))
    rel = d / (F.abs("true_value") + EPS)
    return both.select("*", d.alias("abs_diff"), rel.alias("rel_diff"), (1 - rel).alias("similarity"))


def metric_summary(x10: DataFrame, group: list[str]) -> DataFrame:
    t, p = F.col("true_value"), F.col("pred_value")
    s = x10.groupBy(*group, "metric").agg(
        F.avg(t).alias("true_mean"), F.avg(p).alias("pred_mean"), F.avg("abs_diff").alias("abs_diff_mean"), F.avg("similarity").alias("similarity_mean"), F.count(t * p).alias("n"),
        F.sum(t).alias("sx"), F.sum(p).alias("sy"), F.sum(t * t).alias("sxx"), F.sum(p * p).alias("syy"), F.sum(t * p).alias("sxy"),
    )
    return s.select(*group, "metric", "true_mean", "pred_mean", "abs_diff_mean", "similarity_mean", "n", guarded(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("corr"))

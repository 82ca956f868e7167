"""Graphs as sparse edge tables: one row for each upper-triangle cell that isn't 0, keyed by (subject, session, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajgraph.functions.labels import METRICS


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def pair(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """Rows with both nodes in 1..n, with i = the smaller and j = the larger node."""
    kept = df.where((F.least(a, b) >= 1) & (F.greatest(a, b) <= n))
    return kept.withColumn("i", F.least(a, b)).withColumn("j", F.greatest(a, b))


def edges(df: DataFrame, a: str, b: str, keys: list[str], n: int, weight: str | None = None, agg: str = "count") -> DataFrame:
    """(keys, i, j, w): count, mean or sum of finite weights; cells of weight 0 are absent."""
    p = pair(df, a, b, n)
    if agg == "count":
        out = p.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).cast("double").alias("w"))
    else:
        w = F.when(finite(F.col(weight)), F.col(weight))
        out = p.groupBy(*keys, "i", "j").agg((F.sum(w) if agg == "sum" else F.avg(w)).alias("w"))
    return out.where(F.col("w").isNotNull() & (F.col("w") != 0))


def edges_all_metrics(df: DataFrame, versions: dict[str, tuple[str, str]], metrics: list[str], keys: list[str], n: int) -> DataFrame:
    """(keys, version, ctype, i, j, w) of all versions and metrics in one shuffle.

    versions: name -> node columns. metrics: weight columns named as in METRICS, `nos` for counts. Each row is sent on once a
    version, with all its weights; the aggregation has a column for each metric, unpivoted behind the shuffle.
    """
    longs = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j")) for v, (a, b) in versions.items()]))
    weights = [m for m in metrics if m != "nos"]
    each = df.select(*keys, *weights, longs.alias("p")).select(*keys, *weights, "p.*").where((F.col("i") >= 1) & (F.col("j") <= n))
    value = lambda m: F.when(finite(F.col(m)), F.col(m))
    aggs = [F.count(F.lit(1)).cast("double").alias("nos")] + [(F.sum(value(m)) if METRICS.get(m) == "sum" else F.avg(value(m))).alias(m) for m in weights]
    wide = each.groupBy(*keys, "version", "i", "j").agg(*aggs)
    out = wide.unpivot([*keys, "version", "i", "j"], metrics, "ctype", "w")
    return out.where(F.col("w").isNotNull() & (F.col("w") != 0)).select(*keys, "version", "ctype", "i", "j", "w")


def edges_both(df: DataFrame, true: tuple[str, str], pred: tuple[str, str], metrics: list[str], keys: list[str], n: int) -> DataFrame:
    """(keys, ctype, i, j, t, p): the graphs of two versions side by side, over the cells of either, in one shuffle and no join.

    A row whose cell is the same in both versions is sent on once.
    """
    cell = lambda v: F.struct(F.least(*v).alias("i"), F.greatest(*v).alias("j"))
    weights = [m for m in metrics if m != "nos"]
    each = df.select(*keys, *weights, cell(true).alias("_t"), cell(pred).alias("_p"))
    each = each.select(*keys, *weights, "_t", "_p", F.explode(F.array_distinct(F.array("_t", "_p"))).alias("c")).where((F.col("c.i") >= 1) & (F.col("c.j") <= n))
    each = each.select(*keys, *weights, "c.i", "c.j", (F.col("_t") == F.col("c")).alias("_t"), (F.col("_p") == F.col("c")).alias("_p"))
    aggs = []
    for side in ("_t", "_p"):
        for m in metrics:
            if m == "nos":
                aggs.append(F.sum(F.col(side).cast("double")).alias(f"{side}_nos"))
            else:
                v = F.when(F.col(side) & finite(F.col(m)), F.col(m))
                aggs.append((F.sum(v) if METRICS.get(m) == "sum" else F.avg(v)).alias(f"{side}_{m}"))
    wide = each.groupBy(*keys, "i", "j").agg(*aggs)
    value = lambda side, m: F.coalesce(F.col(f"{side}_{m}"), F.lit(0.0)).cast("double")
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("ctype"), value("_t", m).alias("t"), value("_p", m).alias("p")) for m in metrics]))
    return wide.select(*keys, "i", "j", x.alias("x")).select(*keys, "x.ctype", "i", "j", "x.t", "x.p").where((F.col("t") != 0) | (F.col("p") != 0))


def edges_accuracy(df: DataFrame, true: str, pred: str, keys: list[str]) -> DataFrame:
    """(keys, label, accuracy): share of right predictions of each true label; labels only predicted get 1."""
    right = df.groupBy(*keys, F.col(true).alias("label")).agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))
    labels = df.select(*keys, F.col(true).alias("label")).union(df.select(*keys, F.col(pred).alias("label"))).distinct()
    return labels.join(right, [*keys, "label"], "left").withColumn("accuracy", F.coalesce("accuracy", F.lit(1.0)))


def edges_diff(b: DataFrame) -> DataFrame:
    """Cells of either side (t, p) with diff, abs_diff and rel_diff; a relative difference to 0 is 0."""
    d = F.col("t") - F.col("p")
    return b.select("*", d.alias("diff"), F.abs(d).alias("abs_diff"), F.coalesce(F.try_divide(d, F.col("t")), F.lit(0.0)).alias("rel_diff"))


def population_mean(e: DataFrame, keys: list[str], subject: str = "subject_id") -> DataFrame:
    """(keys, i, j, w, n_subjects): mean over the subjects that have a graph of these keys; absent cells count as 0."""
    n = e.groupBy(*keys).agg(F.countDistinct(subject).alias("n_subjects"))
    return e.groupBy(*keys, "i", "j").agg(F.sum("w").alias("s")).join(n, keys).select(*keys, "i", "j", (F.col("s") / F.col("n_subjects")).alias("w"), "n_subjects")


def contributing_subjects(e: DataFrame, keys: list[str], subject: str = "subject_id") -> DataFrame:
    return e.select(*keys, subject).distinct()


def align_nodes(e: DataFrame, shifted: bool) -> DataFrame:
    """Graphs that lack the first node: indices move up by one. Graphs that lack the last one stay as they are."""
    return e.withColumn("i", F.col("i") + 1).withColumn("j", F.col("j") + 1) if shifted else e


def multiplicity() -> Column:
    """Cells of the full matrix that an upper-triangle cell stands for."""
    return F.when(F.col("i") == F.col("j"), 1).otherwise(2)


def graph_profile(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Strength, cells that aren't 0, mean, population deviation, least and largest cell of the full matrix, zeros included."""
    m = multiplicity()
    s = e.groupBy(*keys).agg(F.sum(m * F.col("w")).alias("strength"), F.sum(m).alias("nonzero"), F.sum(m * F.col("w") * F.col("w")).alias("q"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    mean, zeros = F.col("strength") / (n * n), F.col("nonzero") < n * n
    return s.select(
        *keys, "strength", "nonzero", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / (n * n) - mean * mean, F.lit(0.0))).alias("std"),
        F.when(zeros, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("least"), F.when(zeros, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("largest"),
    )


def validate(raw: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Checks of raw cells (i, j, w; both triangles): counts, symmetry, spread over the whole matrix (absent cells are 0) and a list of
    issues; valid if there is none."""
    other = raw.select(*keys, F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("w2"))
    both = raw.join(other, [*keys, "i", "j"], "left")
    bad = F.coalesce(F.abs(F.col("w") - F.col("w2")) > 1e-9, F.col("w") != 0)
    s = both.groupBy(*keys).agg(
        F.sum((F.col("w") != 0).cast("int")).alias("nnz"), F.sum(F.isnan("w").cast("int")).alias("n_nan"), F.sum((F.abs("w") == float("inf")).cast("int")).alias("n_inf"),
        F.sum((F.col("w") < 0).cast("int")).alias("n_negative"), F.sum(bad.cast("int")).alias("n_skew"),
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.count(F.lit(1)).alias("k"),
    )
    issues = F.array_compact(F.array(F.when(F.col("nnz") == 0, "empty"), F.when(F.col("n_negative") > 0, "negative"), F.when(F.col("n_nan") > 0, "nan"), F.when(F.col("n_inf") > 0, "inf")))
    mean, full = F.col("s") / (n * n), F.col("k") >= n * n
    return s.select(
        *keys, "nnz", (1 - F.col("nnz") / (n * n)).alias("sparsity"), mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / (n * n) - mean * mean, F.lit(0.0))).alias("std"), F.when(full, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))).alias("min"), F.when(full, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))).alias("max"), "n_nan", "n_inf",
        (F.col("n_skew") == 0).alias("symmetric"), F.concat_ws(",", issues).alias("issues"), (F.size(issues) == 0).alias("valid"),
    )


def total_drift(e: DataFrame, keys: list[str], limit: float = 50.0) -> DataFrame:
    """Difference of the totals of the versions true and pred, in percent of the larger; warn beyond the limit."""
    total = lambda v: F.coalesce(F.sum(F.when(F.col("version") == v, multiplicity() * F.col("w"))), F.lit(0.0))
    s = e.groupBy(*keys).agg(total("true").alias("t"), total("pred").alias("p"))
    drift = F.coalesce(F.try_divide(F.abs(F.col("t") - F.col("p")) * 100, F.greatest("t", "p")), F.lit(0.0))
    return s.select(*keys, "t", "p", drift.alias("drift"), (drift > limit).alias("warn"))


def edges_min_length(df: DataFrame, length: str, least: float, versions: dict[str, tuple[str, str]], metrics: list[str], keys: list[str], n: int) -> DataFrame:
    """All graphs of the rows of at least a length: one filter for labels, predictions and weights."""
    return edges_all_metrics(df.where(F.col(length) >= least), versions, metrics, keys, n)


def load_pairs(e: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of the keys for which both versions exist and neither is all 0."""
    has = e.groupBy(*keys).agg(F.countDistinct("version").alias("v"), F.min(F.abs("w")).alias("w")).where(F.col("v") == 2).select(*keys)
    return e.join(has, keys, "left_semi")


def missing_outputs(expected: DataFrame, existing: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Groups of which any key has no output: the whole group is to be done again."""
    return expected.join(existing, keys, "left_anti").select(*group).distinct()

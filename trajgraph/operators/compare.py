"""Comparison of two graphs by key, on sparse edges with the known number of cells.

Sums over a full outer join of the edges and the number of cells give every moment of the dense triangle or matrix; only ranks
need the dense cells. A constant side makes a correlation null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajgraph.functions.ranks import quantiles
from trajgraph.functions.tables import kept

#: Weightings whose zeros mean "not measured".
MASKED = ("fa", "md", "ad", "rd")
EPS = 1e-10


def cells(n: int, diagonal: bool = True) -> int:
    return n * (n + 1) // 2 if diagonal else n * (n - 1) // 2


def for_both(b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, t, p) of the keys for which both sides have an edge. The window deals by keys, as later aggregations do."""
    by = Window.partitionBy(*keys)
    has = lambda c: F.max(F.col(c) != 0).over(by)
    return b.select(*keys, "i", "j", "t", "p", (has("t") & has("p")).alias("_both")).where("_both").drop("_both")


def paired(e: DataFrame, keys: list[str], column: str, t: str, p: str) -> DataFrame:
    """(keys, i, j, t, p) of the edges with the values t and p of a column side by side, for keys that have both: one aggregation."""
    side = lambda v: F.coalesce(F.sum(F.when(F.col(column) == v, F.col("w"))), F.lit(0.0))
    return for_both(e.where(F.col(column).isin(t, p)).groupBy(*keys, "i", "j").agg(side(t).alias("t"), side(p).alias("p")), keys)


def both_sides(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, t, p) over the cells of either of two tables, for keys that both have."""
    on = [*keys, "i", "j"]
    full = x.select(*on, F.col("w").alias("t"), F.lit(0.0).alias("p")).unionByName(y.select(*on, F.lit(0.0).alias("t"), F.col("w").alias("p")))
    return for_both(full.groupBy(*on).agg(F.sum("t").alias("t"), F.sum("p").alias("p")), keys)


def densify(e: DataFrame, keys: list[str], n: int, diagonal: bool = True) -> DataFrame:
    """Every upper-triangle cell of each key, zeros included."""
    rows = F.explode(F.sequence(F.lit(1), F.lit(n if diagonal else n - 1))).alias("i")
    grid = e.select(*keys).distinct().select(*keys, rows)
    grid = grid.select(*keys, "i", F.explode(F.sequence(F.col("i") + (0 if diagonal else 1), F.lit(n))).alias("j"))
    own = e.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w")
    return grid.join(own, [*keys, "i", "j"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def zero_mask(b: DataFrame, ctype: str = "ctype") -> DataFrame:
    """Cells of masked weightings stay only where both sides aren't 0."""
    return b.where(~F.col(ctype).isin(*MASKED) | ((F.col("t") != 0) & (F.col("p") != 0)))


def masked_count(b: DataFrame, keys: list[str], n: int, ctype: str = "ctype") -> DataFrame:
    """Cells of the full matrix that zero_mask blanks."""
    kept = F.sum(F.when((F.col("t") != 0) & (F.col("p") != 0), F.when(F.col("i") == F.col("j"), 1).otherwise(2)).otherwise(0))
    return b.groupBy(*keys).agg(kept.alias("k")).select(*keys, F.when(F.col(ctype).isin(*MASKED), n * n - F.col("k")).otherwise(0).alias("n_masked"))


def nonzero_either(b: DataFrame) -> DataFrame:
    return b.where((F.col("t") != 0) | (F.col("p") != 0))


def guarded(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; null for a constant side (up to rounding) or fewer than two cells."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    ok = (n > 1) & (vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy)
    return F.when(ok, (n * sxy - sx * sy) / (F.sqrt(F.when(ok, vx)) * F.sqrt(F.when(ok, vy))))


def sums(m: Column | None = None) -> list[Column]:
    t, p = F.col("t"), F.col("p")
    m = F.lit(1) if m is None else m
    return [F.sum(m * t).alias("sx"), F.sum(m * p).alias("sy"), F.sum(m * t * t).alias("sxx"), F.sum(m * p * p).alias("syy"), F.sum(m * t * p).alias("sxy"), F.sum(m).alias("k")]


def _r(n: Column) -> Column:
    return guarded(n, *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])


def pearson_dense(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All upper-triangle cells."""
    return b.groupBy(*keys).agg(*sums()).select(*keys, _r(F.lit(cells(n))).alias("r"))


def pearson_nonzero(b: DataFrame, keys: list[str]) -> DataFrame:
    """Only cells where neither side is 0."""
    out = b.where((F.col("t") != 0) & (F.col("p") != 0)).groupBy(*keys).agg(*sums()).select(*keys, _r(F.col("k")).alias("r"))
    return b.select(*keys).distinct().join(out, keys, "left")


def pearson_z(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean product of population z-scores with EPS added to each deviation: a constant side gives 0."""
    k = cells(n)
    mx, my = F.col("sx") / k, F.col("sy") / k
    dev = lambda s, m: F.sqrt(F.greatest(F.col(s) / k - m * m, F.lit(0.0))) + EPS
    return b.groupBy(*keys).agg(*sums()).select(*keys, ((F.col("sxy") / k - mx * my) / (dev("sxx", mx) * dev("syy", my))).alias("r"))


def pearson_full(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The flattened matrix: cells off the diagonal count twice."""
    m = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    return b.groupBy(*keys).agg(*sums(m)).select(*keys, _r(F.lit(n * n)).alias("r"))


def spearman(b: DataFrame, keys: list[str], n: int, full: bool = False) -> DataFrame:
    """Pearson's r of average ranks over all upper-triangle cells, or of the full matrix, whose cells off the diagonal count twice.

    The zeros of a side share one rank, so only the cells of either side are ranked: those over 0 are moved up by the number of
    absent cells. No dense grid is made, and both sides are ranked in one pass over the cells of a key.
    """
    k = n * n if full else cells(n)
    m = F.when(F.col("i") == F.col("j"), 1).otherwise(2) if full else F.lit(1)
    by = Window.partitionBy(*keys)
    c = b.withColumn("m", m).withColumn("rest", k - F.sum("m").over(by))
    for v, r in (("t", "rt"), ("p", "rp")):
        below = F.coalesce(F.sum("m").over(by.orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
        same = F.sum("m").over(Window.partitionBy(*keys, v))
        x = F.col(v)
        rank = below - same + F.when(x > 0, F.col("rest")).otherwise(0) + (same + F.when(x == 0, F.col("rest")).otherwise(0) + 1) / 2
        c = c.withColumn(r, rank)
        negative = F.sum(F.when(x < 0, F.col("m")).otherwise(0)).over(by)
        zeros = F.sum(F.when(x == 0, F.col("m")).otherwise(0)).over(by) + F.col("rest")
        c = c.withColumn(f"{r}0", negative + (zeros + 1) / 2)  # the rank of an absent cell
    t, p, w = F.col("rt"), F.col("rp"), F.col("m")
    s = c.groupBy(*keys).agg(F.sum(w * t).alias("sx"), F.sum(w * p).alias("sy"), F.sum(w * t * t).alias("sxx"), F.sum(w * p * p).alias("syy"), F.sum(w * t * p).alias("sxy"), F.first("rt0").alias("z_t"), F.first("rp0").alias("z_p"), F.first("rest").alias("rest"))
    add = lambda c, v: (F.col(c) + F.col("rest") * v).alias(c)
    s = s.select(*keys, add("sx", F.col("z_t")), add("sy", F.col("z_p")), add("sxx", F.col("z_t") * F.col("z_t")), add("syy", F.col("z_p") * F.col("z_p")), add("sxy", F.col("z_t") * F.col("z_p")))
    return s.select(*keys, _r(F.lit(k)).alias("r"))


def errors(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """mse, rmse, mae over the dense triangle."""
    d, k = F.col("t") - F.col("p"), cells(n)
    s = b.groupBy(*keys).agg((F.sum(d * d) / k).alias("mse"), (F.sum(F.abs(d)) / k).alias("mae"))
    return s.select(*keys, "mse", F.sqrt("mse").alias("rmse"), "mae")


def errors_off_diagonal(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    d, k = F.when(F.col("i") != F.col("j"), F.col("t") - F.col("p")).otherwise(0.0), n * (n - 1)
    return b.groupBy(*keys).agg(F.sqrt(F.sum(2 * d * d) / k).alias("rmse"), (F.sum(2 * F.abs(d)) / k).alias("mae"))


def errors_legacy(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Full matrix: mse, the sum of absolute differences, and that over the sum of the true side (0 if that isn't positive)."""
    d, m = F.col("t") - F.col("p"), F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    s = b.groupBy(*keys).agg((F.sum(m * d * d) / (n * n)).alias("mse"), F.sum(m * F.abs(d)).alias("abs_err_sum"), F.sum(m * F.col("t")).alias("st"))
    return s.select(*keys, "mse", "abs_err_sum", F.when(F.col("st") > 0, F.try_divide("abs_err_sum", "st")).otherwise(0.0).alias("mape"))


def mean_relative_error(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    x = F.abs(F.col("t") - F.col("p")) / (F.abs("t") + F.abs("p") + EPS)
    return b.groupBy(*keys).agg((F.sum(x) / cells(n)).alias("mean_relative_error"))


def norms(b: DataFrame, keys: list[str]) -> DataFrame:
    d, m = F.col("t") - F.col("p"), F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    return b.groupBy(*keys).agg(F.sqrt(F.sum(m * d * d)).alias("frobenius"), F.max(F.abs(d)).alias("max_abs_error"))


def wasserstein(b: DataFrame, keys: list[str], n: int, full: bool = False) -> DataFrame:
    """Mean distance of the sorted cells of both dense triangles (or full matrices): the area between the two distribution functions,
    over the number of cells. Only distinct values and their counts are ordered; cells absent on both sides cancel out."""
    k = n * n if full else cells(n)
    m = F.when(F.col("i") == F.col("j"), 1).otherwise(2) if full else F.lit(1)
    sides = F.explode(F.array(F.struct(F.col("t").alias("w"), m.alias("c")), F.struct(F.col("p").alias("w"), (-m).alias("c"))))
    both = b.select(*keys, sides.alias("x")).groupBy(*keys, "x.w").agg(F.sum("x.c").alias("c"))
    order = Window.partitionBy(*keys).orderBy("w")
    gap = F.lead("w").over(order) - F.col("w")
    area = both.withColumn("a", F.abs(F.sum("c").over(order)) * F.coalesce(gap, F.lit(0.0)))
    return area.groupBy(*keys).agg((F.sum("a") / k).alias("wasserstein"))


def overlap(b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells over 0 of both sides, to those of the true side and to those of either."""
    one = lambda c: F.sum(c.cast("int"))
    t, p = F.col("t") > 0, F.col("p") > 0
    s = b.groupBy(*keys).agg(one(t & p).alias("k"), one(t).alias("nt"), one(t | p).alias("ne"))
    return s.select(*keys, (F.col("k") / F.greatest("nt", F.lit(1))).alias("edge_overlap"), (F.col("k") / F.greatest("ne", F.lit(1))).alias("jaccard"))


def strength_ratio(b: DataFrame, keys: list[str]) -> DataFrame:
    m = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    return b.groupBy(*keys).agg((F.sum(m * F.col("p")) / F.greatest(F.sum(m * F.col("t")), F.lit(EPS))).alias("strength_ratio"))


def rel_diff_mean(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    x = F.coalesce(F.try_divide(2 * F.abs(F.col("t") - F.col("p")), F.col("t") + F.col("p")), F.lit(0.0))
    return b.groupBy(*keys).agg((F.sum(x) / cells(n)).alias("rel_diff_mean"))


def log_diff_mean(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean difference of logarithms off the diagonal; cells that are 0 on both sides add nothing."""
    x = F.abs(F.log(F.col("p") + EPS) - F.log(F.col("t") + EPS))
    return b.groupBy(*keys).agg((F.sum(F.when(F.col("i") != F.col("j"), x).otherwise(0.0)) / cells(n, False)).alias("log_diff_mean"))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenvalues and vectors of a symmetric matrix that has a logarithm (all eigenvalues finite and none 0), else None."""
    if not np.isfinite(a).all():
        return None
    values, vectors = np.linalg.eigh(a)
    return (values, vectors) if np.abs(values).min(initial=np.inf) > 0 else None


def log_parts(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real part of the principal logarithm, and its imaginary part: pi times the projector onto the negative eigenspace, as the
    logarithm of a negative eigenvalue is that of its absolute value plus i pi."""
    below = vectors[:, values < 0]
    return (vectors * np.log(np.abs(values))) @ vectors.T, np.pi * (below @ below.T)


def dense(pdf: pd.DataFrame, n: int, column: str = "w") -> np.ndarray:
    """The full symmetric matrix of the upper-triangle cells of one graph."""
    a = np.zeros((n, n))
    i, j = pdf["i"].to_numpy() - 1, pdf["j"].to_numpy() - 1
    a[i, j] = a[j, i] = pdf[column]
    return a


def log_vectors(e: DataFrame, keys: list[str], n: int, eps: float = EPS, imaginary: bool = False) -> DataFrame:
    """(keys, log): the matrix logarithm of each dense symmetric matrix, eps added on its diagonal, as one vector: the upper triangle,
    cells off the diagonal times the root of 2, so that the Euclidean distance of two vectors is the Frobenius norm of the difference
    of the logarithms.

    By default the real part; with imaginary the vector goes on with the imaginary part, and the distance is the norm of the complex
    difference. One graph of n x n cells is a group. Graphs without a logarithm (a zero eigenvalue) have no row.
    """
    at = np.triu_indices(n)
    scale = np.where(at[0] == at[1], 1.0, 2.0**0.5)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found = eigen(dense(pdf, n) + eps * np.eye(n))
        if found is None:
            return pd.DataFrame(columns=[*keys, "log"])
        parts = log_parts(*found)[: 2 if imaginary else 1]
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"log": [np.concatenate([scale * part[at] for part in parts])]})

    shape = T.StructType([*[e.schema[k] for k in keys], T.StructField("log", T.ArrayType(T.DoubleType()))])
    return e.select(*keys, "i", "j", "w").groupBy(*keys).applyInPandas(work, shape)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: The gated distance: the largest cell of both sides over LEAST_TOP, condition numbers under CONDITION; SHARE of the smaller largest cell is added to all cells.
LEAST_TOP, CONDITION, SHARE = 1e-6, 1e12, 1e-6


def gated_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Complex log-Euclidean distance of two well-conditioned matrices without negative cells; nan where a gate is shut.

    The condition number of a symmetric matrix is that of its eigenvalues, the largest to the smallest in size.
    """
    if min(a.min(), b.min()) < 0 or min(a.max(), b.max()) <= LEAST_TOP:
        return np.nan
    shift = max(EPS, min(a.max(), b.max()) * SHARE)
    logs = []
    for m in (a, b):
        found = eigen(m)
        if found is None or np.abs(found[0]).max() >= CONDITION * np.abs(found[0]).min():
            return np.nan
        moved = eigen(m + shift)
        if moved is None:
            return np.nan
        logs.append(log_parts(*moved))
    (ra, ia), (rb, ib) = logs
    return float(np.sqrt(((ra - rb) ** 2).sum() + ((ia - ib) ** 2).sum()))


def lerm_flavours(b: DataFrame, keys: list[str], n: int, eps: float = EPS) -> DataFrame:
    """(keys, lerm_real, lerm_complex, lerm_well): log-Euclidean distances of both sides of each key, from one pass with one group a key.

    lerm_real: norm of the difference of the real parts; lerm_complex: of the complex difference; both null where a side has no
    logarithm. lerm_well: gated_distance, null where a gate is shut.
    """
    names = ["lerm_real", "lerm_complex", "lerm_well"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        t, p = dense(pdf, n, "t"), dense(pdf, n, "p")
        found = [eigen(m + eps * np.eye(n)) for m in (t, p)]
        real = full = np.nan
        if None not in found:
            (rt, it), (rp, ip) = (log_parts(*x) for x in found)
            q = ((rt - rp) ** 2).sum()
            real, full = np.sqrt(q), np.sqrt(q + ((it - ip) ** 2).sum())
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | dict(zip(names, ([float(x)] for x in (real, full, gated_distance(t, p))), strict=True)))

    shape = T.StructType([*[b.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in names]])
    out = b.select(*keys, "i", "j", "t", "p").groupBy(*keys).applyInPandas(work, shape)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def lerm(b: DataFrame, keys: list[str], n: int, flavour: str = "real") -> DataFrame:
    """(keys, lerm): the log-Euclidean distance of both sides; flavour: real, complex or gated.

    real and complex have no row where a side has no logarithm; gated falls back to the mean relative difference (rel_diff_mean).
    """
    each = lerm_flavours(b, keys, n)
    if flavour == "gated":
        return each.join(rel_diff_mean(b, keys, n), keys).select(*keys, F.coalesce("lerm_well", "rel_diff_mean").alias("lerm"))
    return each.select(*keys, F.col(f"lerm_{flavour}").alias("lerm")).where(F.col("lerm").isNotNull())


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def p_of_r(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation of n pairs, by Student's t."""
    import math

    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
    if x == 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def corr_pvalue(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for r, n in batches:
        yield pd.Series([p_of_r(None if pd.isna(x) else float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype=float)


def graph_compare(b: DataFrame, keys: list[str], n: int, mask: str | None = None, spread: bool = True, p_values: bool = False, logs: bool = False) -> DataFrame:
    """Comparisons of two sides in one row a key, from one aggregation of the cells of either side.

    mask: the column of the weighting; cells of masked weightings then count only where both sides aren't 0 (their number is
    n_masked). spread: also Spearman's r and the Wasserstein distance; p_values: those of both correlations; logs: the log-Euclidean
    distances: lerm of the complex difference (null where a side has no logarithm), lerm_real of the real parts, and mean_lerm, the
    gated one with its fallback.
    """
    t, p, k = F.col("t"), F.col("p"), cells(n)
    m = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    masked = None
    if mask is not None:
        masked, b = masked_count(b, keys, n, mask), zero_mask(b, mask)
    d = t - p
    one = lambda c: F.sum(c.cast("int"))
    s = b.groupBy(*keys).agg(
        *sums(), F.sum(d * d).alias("dd"), F.sum(F.abs(d)).alias("ad"), F.sum(F.abs(d) / (F.abs(t) + F.abs(p) + EPS)).alias("re"), F.sum(m * d * d).alias("mdd"), F.sum(m * F.abs(d)).alias("mad"), F.max(F.abs(d)).alias("max_abs_error"),
        one((t > 0) & (p > 0)).alias("kb"), one(t > 0).alias("n_true"), one(p > 0).alias("n_pred"), one((t > 0) | (p > 0)).alias("ke"), F.sum(m * t).alias("mt"), F.sum(m * p).alias("mp"),
        F.sum(F.coalesce(F.try_divide(2 * F.abs(d), t + p), F.lit(0.0))).alias("rd"), F.sum(F.when(F.col("i") != F.col("j"), F.abs(F.log(p + EPS) - F.log(t + EPS))).otherwise(0.0)).alias("ld"),
    )
    out = s.select(
        *keys, _r(F.lit(k)).alias("pearson_r"), (F.col("dd") / k).alias("mse"), F.sqrt(F.col("dd") / k).alias("rmse"), (F.col("ad") / k).alias("mae"), (F.col("re") / k).alias("mean_relative_error"),
        F.sqrt("mdd").alias("frobenius"), "max_abs_error", F.when(F.col("mt") > 0, F.try_divide("mad", "mt")).otherwise(0.0).alias("mape"), (F.col("kb") / F.greatest("n_true", F.lit(1))).alias("edge_overlap"), (F.col("kb") / F.greatest("ke", F.lit(1))).alias("jaccard"),
        F.col("mt").alias("true_strength"), F.col("mp").alias("pred_strength"), (F.col("mp") / F.greatest("mt", F.lit(EPS))).alias("strength_ratio"), (F.col("mt") / (n * n)).alias("true_mean"), (F.col("mp") / (n * n)).alias("pred_mean"),
        (F.col("rd") / k).alias("rel_diff_mean"), (F.col("ld") / cells(n, False)).alias("log_diff_mean"), "n_true", "n_pred",
    )
    if masked is not None:
        out = out.join(masked, keys)
    if spread:
        out = out.join(spearman(b, keys, n).withColumnRenamed("r", "spearman_r"), keys).join(wasserstein(b, keys, n), keys)
    if p_values:
        out = out.withColumn("pearson_p", corr_pvalue(F.col("pearson_r"), F.lit(k)))
        out = out.withColumn("spearman_p", corr_pvalue(F.col("spearman_r"), F.lit(k))) if spread else out
    if logs:
        out = out.join(lerm_flavours(b, keys, n).withColumnRenamed("lerm_complex", "lerm"), keys, "left").withColumn("mean_lerm", F.coalesce("lerm_well", "rel_diff_mean")).drop("lerm_well")
    return out


def error_histogram(b: DataFrame, keys: list[str], bins: int = 50, digits: int | None = None) -> DataFrame:
    """(keys, bin, n): absolute differences off the diagonal of the cells in b, in equal bins between the least and the largest.

    digits: places that count, so that differences equal but for their last bits fall into one bin.
    """
    x, edge = F.abs(F.col("t") - F.col("p")), F.lit(0.0 if digits is None else 1e-6)
    d = b.where(F.col("i") != F.col("j")).select(*keys, (x if digits is None else F.round(x, digits)).alias("x"))
    by = d.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins + edge), F.lit(bins - 1))).otherwise(0)
    return d.join(by, keys).groupBy(*keys, bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bland_altman(b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Bias and limits of agreement (1.96 population deviations) of pred - true off the diagonal, absent cells included."""
    k, d = cells(n, False), F.when(F.col("i") != F.col("j"), F.col("p") - F.col("t")).otherwise(0.0)
    s = b.groupBy(*keys).agg((F.sum(d) / k).alias("bias"), F.sum(d * d).alias("q"))
    sd = F.sqrt(F.greatest(F.col("q") / k - F.col("bias") * F.col("bias"), F.lit(0.0)))
    return s.select(*keys, "bias", (F.col("bias") - 1.96 * sd).alias("lower"), (F.col("bias") + 1.96 * sd).alias("upper"))


def clip_range(e: DataFrame, keys: list[str], share: float = 0.99) -> DataFrame:
    """(keys, lo, hi): the percentile of absolute weights; about 0 if some weight is negative, else from 0."""
    finite = kept(e.where((F.col("w") != 0) & ~F.isnan("w") & (F.abs("w") < float("inf"))).select(*keys, "w", F.abs("w").alias("size")))
    s = finite.groupBy(*keys).agg(F.min("w").alias("least")).join(quantiles(finite, keys, "size", [share]), keys)
    return s.select(*keys, F.when(F.col("least") < 0, -F.col("q")[0]).otherwise(0.0).alias("lo"), F.col("q")[0].alias("hi"))

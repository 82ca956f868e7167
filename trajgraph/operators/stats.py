"""Summaries, paired tests, rankings and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajgraph.functions.ranks import quantiles, row_numbers, running_sums
from trajgraph.functions.tables import kept


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def describe(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, mean, std, median, min, max, q25, q75) of each numeric column."""
    long_ = df.unpivot(keys, columns, "column", "x") if keys else df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    long_ = kept(long_)
    s = long_.groupBy(*keys, "column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    s = s.join(quantiles(long_, [*keys, "column"], "x", [0.25, 0.5, 0.75]), [*keys, "column"], "left")
    return s.select(*keys, "column", "mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def pivot_paired(df: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One column for each value of `column`; rows that lack one are dropped."""
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value)).dropna(subset=values)


def common_subjects(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    return x.select(*keys).intersect(y.select(*keys))


def wilcoxon(df: DataFrame, x: str, y: str, keys: list[str], min_n: int = 2) -> DataFrame:
    """(keys, n, w_plus, w_minus, w, z2, ties): signed-rank sums of the differences that aren't 0; average ranks of their sizes.

    Groups of fewer than min_n pairs have no row. z2 is the variance of the sum under the null with ties.
    """
    d = df.select(*keys, F.round(F.col(x) - F.col(y), 12).alias("d")).where(F.col("d") != 0)
    # Differences of one size are one row with their numbers; their average rank lies in the middle of their places.
    sizes = d.groupBy(*keys, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("same"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    r = running_sums(sizes, keys, ["size"], F.col("same"), "below").withColumn("rank", F.col("below") + (F.col("same") + 1) / 2)
    same = F.col("same")
    s = r.groupBy(*keys).agg(F.sum(same).alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((same - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(same * (same * same - 1)).cast("double").alias("ties"))
    return s.where(F.col("n") >= min_n).withColumn("w", F.least("w_plus", "w_minus"))


def p_of_w(w: float, n: int, ties: float) -> float:
    """Two-sided p-value: exact for up to 25 differences without ties, else the normal approximation."""
    if n <= 25 and not ties:
        counts = [1]
        for k in range(1, n + 1):
            counts = [(counts[i] if i < len(counts) else 0) + (counts[i - k] if i >= k else 0) for i in range(len(counts) + k)]
        return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for w, n, ties in batches:
        yield pd.Series([p_of_w(float(a), int(b), float(c)) for a, b, c in zip(w, n, ties, strict=True)], dtype=float)


def representatives(df: DataFrame, keys: list[str], columns: list[str], tie: str, n: int = 5) -> DataFrame:
    """n rows of each key at even ranks of the mean of the columns (nulls skipped), from the least to the largest; all if fewer."""
    filled = [F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)) for c in columns]
    mean = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in filled[1:]), F.coalesce(filled[0], F.lit(0.0))), sum((c.isNotNull().cast("int") for c in filled[1:]), filled[0].isNotNull().cast("int")))
    ranked = row_numbers(df.withColumn("mean_score", mean), keys, ["mean_score", tie], "rank")
    ranked = ranked.join(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    places = F.array(*[F.floor(F.col("_n") * k / (n - 1)) if k < n - 1 else F.col("_n") - 1 for k in range(n)])
    return ranked.where((F.col("_n") < n) | F.array_contains(places, F.col("rank").cast("long"))).drop("_n")


def leaderboard(df: DataFrame, keys: list[str], value: str, tie: str, k: int = 5) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), tie)
    return df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, and the least and largest value within 1.5 interquartile ranges of them."""
    df = kept(df)
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, keys).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "median", "q3").agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))


def select_values(df: DataFrame, column: str, values: list, value: str, new_name: str) -> DataFrame:
    return df.where(F.col(column).isin(*values)).dropna(subset=[value]).withColumnRenamed(value, new_name)


def run_manifest(e: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of graphs and edges, and the names of the weightings in order."""
    return e.agg(F.countDistinct(*keys).alias("n_graphs"), F.count(F.lit(1)).alias("n_edges"), F.concat_ws(",", F.sort_array(F.collect_set("ctype"))).alias("ctypes"))

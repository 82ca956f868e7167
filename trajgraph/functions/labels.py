"""Column helpers for node-pair labels. Null in, null out, unless a helper says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Atlas names with their real nodes (fixed values); node 0 is background.
ATLASES = {"aparc+aseg": 84, "aparc.a2009s+aseg": 164}
#: Edge weightings with their aggregation (fixed values).
METRICS = {"nos": "count", "fa": "mean", "md": "mean", "ad": "mean", "rd": "mean", "sift2": "sum"}
#: Names for display (fixed values).
METRIC_NAMES = {"nos": "NoS-weighted", "fa": "FA-weighted", "md": "MD-weighted", "ad": "AD-weighted", "rd": "RD-weighted", "sift2": "SIFT2-weighted"}


def inside(a: Column, b: Column, n: int) -> Column:
    """Both nodes in [0, n)."""
    return (F.least(a, b) >= 0) & (F.greatest(a, b) < n)


def encode_symmetric(a: Column, b: Column, n: int) -> Column:
    """Ordinal of an unordered pair in the upper triangle, row by row; null for a pair outside."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(inside(a, b, n), (lo * n - F.floor(lo * (lo - 1) / 2) + (hi - lo)).cast("long"))


def decode_symmetric(k: Column, n: int) -> tuple[Column, Column]:
    """The pair of a symmetric label; nulls for a label outside [0, n(n+1)/2)."""
    m = 2 * n + 1
    ok = (k >= 0) & (k < n * (n + 1) // 2)
    a = F.floor((F.lit(float(m)) - F.sqrt(F.lit(float(m * m)) - 8 * k)) / 2).cast("long")
    start = (a * n - F.floor(a * (a - 1) / 2)).cast("long")
    return F.when(ok, a), F.when(ok, a + (k - start))


def encode_ordered(a: Column, b: Column, n: int) -> Column:
    """a * n + b, order kept."""
    return F.when(inside(a, b, n), (a * n + b).cast("long"))


def decode_ordered(k: Column, n: int) -> tuple[Column, Column]:
    ok = (k >= 0) & (k < n * n)
    return F.when(ok, F.floor(k / n).cast("long")), F.when(ok, (k % n).cast("long"))


def mask_background(label: Column, n: int) -> Column:
    """Symmetric labels below n touch node 0: they become 0."""
    return F.when(label < n, F.lit(0)).otherwise(label)


def label_dimension(spark: SparkSession, n: int, symmetric: bool = True) -> DataFrame:
    """(label, a, b, name) of all pairs."""
    ids = spark.range(n).withColumnRenamed("id", "a")
    pairs = ids.select("a", F.explode(F.sequence(F.col("a") if symmetric else F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"))
    encode = encode_symmetric if symmetric else encode_ordered
    return pairs.select(encode(F.col("a"), F.col("b"), n).alias("label"), "a", "b", F.concat_ws("_", "a", "b").alias("name"))


def round_half_even(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)


def settled(x: Column, digits: int = 12) -> Column:
    """x to so many digits, so that what the order of additions leaves in the last bits of a sum or mean decides no tie."""
    return F.round(x, digits)


def parse_numbers(s: Column) -> Column:
    """"45_10_10" -> [45.0, 10.0, 10.0]."""
    return F.transform(F.split(s, "_"), lambda x: x.try_cast("double"))


def composite_id(subject: Column, times: int, k: Column) -> Column:
    """One number for (subject, repetition)."""
    return subject * times + k


def split_composite(c: Column, times: int) -> tuple[Column, Column]:
    return F.floor(c / times).cast("long"), (c % times).cast("long")


def stars(p: Column) -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def display_name(ctype: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in METRIC_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, ctype), ctype)


def weight_transform(w: Column, kind: str, largest: Column | None = None, count_like: Column | None = None) -> Column:
    """none, log1p or sqrt of the weight with negatives at 0; auto: log1p where weights count something and reach over 100."""
    safe = F.greatest(w, F.lit(0.0))
    if kind == "auto":
        return F.when(count_like & (largest > 100), F.log1p(safe)).otherwise(w)
    return {"none": w, "log1p": F.log1p(safe), "sqrt": F.sqrt(safe)}[kind]


def relabel(df: DataFrame, node: str, table: DataFrame, old: str, new: str) -> DataFrame:
    """node mapped by a table of distinct (old, new); nodes that it lacks become 0."""
    t = table.select(F.col(old).alias(node), F.col(new).alias("_new"))
    return df.join(t, node, "left").withColumn(node, F.coalesce("_new", F.lit(0))).drop("_new")


def detect_index_base(df: DataFrame, a: str, b: str, n: int, keys: list[str]) -> DataFrame:
    """Pairs with nodes from 0: groups whose largest node is n count from 1. Pairs outside [0, n) go."""
    top = df.groupBy(*keys).agg((F.max(F.greatest(a, b)) == n).cast("int").alias("_shift"))
    moved = df.join(top, keys).withColumn(a, F.col(a) - F.col("_shift")).withColumn(b, F.col(b) - F.col("_shift"))
    return moved.where(inside(F.col(a), F.col(b), n)).drop("_shift")


def cluster_index(name: Column) -> Column:
    """cluster_00031 -> 30."""
    return F.regexp_extract(name, r"cluster_0*([0-9]+)", 1).try_cast("int") - 1


def cluster_to_tract(df: DataFrame, cluster: str, table: DataFrame, others: int, shift: int = 800) -> DataFrame:
    """tract of each cluster by a table of distinct (cluster, tract); clusters shifted by `shift` are others; unknown ones stay."""
    t = table.select(F.col("cluster").alias(cluster), F.col("tract").alias("_tract"))
    both = t.union(t.select(F.col(cluster) + shift, F.lit(others)))
    return df.join(both, cluster, "left").withColumn("tract", F.coalesce("_tract", cluster)).drop("_tract")


def tract_clusters(table: DataFrame, everything: DataFrame) -> DataFrame:
    """(tract, clusters): the clusters of each tract ascending, those in none under Other."""
    named = table.groupBy("tract").agg(F.sort_array(F.collect_list("cluster")).alias("clusters"))
    rest = everything.join(table, "cluster", "left_anti").agg(F.sort_array(F.collect_list("cluster")).alias("clusters"))
    return named.unionByName(rest.select(F.lit("Other").alias("tract"), "clusters"))

"""Row numbers, running sums and quantiles of groups that fit no task.

Rows are dealt by ranges of (keys, order), so a group of any size spreads over tasks. Each task sums its own rows; the sums of the
ranges before, one row a range and group, are added to them. Groups of up to IN_ONE_TASK rows go through a window by group instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajgraph.functions.tables import kept

#: Rows of a group that one task may order.
IN_ONE_TASK = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def running_sums(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows of the same keys that come before, in ascending order of the columns `order` (which
    tell rows apart). Rows whose keys hold null are left out."""
    rows = df.dropna(subset=keys)
    before = lambda by, cols: F.coalesce(F.sum(amount).over(Window.partitionBy(*by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stored = kept(rows)
    if largest_group(stored, keys) <= IN_ONE_TASK:
        return stored.withColumn(name, before(keys, order))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(stored.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sums.select(*keys, "_range", ahead.alias("_start"))
    own = dealt.withColumn("_own", before([*keys, "_range"], order))
    return own.join(start, [*keys, "_range"]).withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", "_range")


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number of each row among those of its keys, from 0."""
    return running_sums(df, keys, order, F.lit(1), name)


def numbered(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """(keys, columns, name): the number of each row among those of its keys, from 0, in ascending order of the columns `order`.

    One shuffle for groups of any size: rows are dealt by ranges and stored in order with their places, the order columns stay behind.
    Rows of null keys are left out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.dropna(subset=keys).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = kept(ordered.select(*keys, *columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id")))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts_of = dealt.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Stored, so that their size is known: a few go to every task, and no row is shuffled again.
    starts = kept(parts_of.select(*keys, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start")))
    return dealt.join(starts, [*keys, "_range"]).select(*keys, *columns, (F.col("_id") + F.col("_start")).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """(keys, q): exact quantiles between neighbouring values, as `percentile` gives them; nulls don't count.

    Equal values are counted first. The distinct values of a large group are placed by running sums of their counts, and only those at
    the asked places are gathered.
    """
    counted = kept(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    if not keys:
        counted = counted.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    if largest_group(counted, by) <= IN_ONE_TASK:
        return counted.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares]), F.col("_n")).alias(name)).select(*keys, name)
    placed = running_sums(counted, by, [value], F.col("_n"), "_below")
    total = counted.groupBy(*by).agg((F.sum("_n") - 1).alias("_last"))
    at = placed.join(total, by)
    held = lambda place: F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col(value).cast("double")))
    wide = at.groupBy(*by, "_last").agg(*[held(f(F.col("_last") * F.lit(float(s)))).alias(f"_{side}{k}") for k, s in enumerate(shares) for side, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda k, s: F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (F.col("_last") * F.lit(float(s)) - F.floor(F.col("_last") * F.lit(float(s))))
    return wide.select(*keys, F.array(*[between(k, s) for k, s in enumerate(shares)]).alias(name))

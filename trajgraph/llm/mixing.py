"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words; complete epochs of it come first, and the rest of its target is filled by documents in the
order of exponential keys ``-ln(u) / weight`` (u hashed from the id, weight from the document's quality) up to the budget. The
prefix sums are taken over bins of the key first; only the bin in which a budget ends is ordered row by row, so a source with a
third of all rows is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajgraph.llm.common import SPACE_WORD, read, stored

#: Weights of the sources in code point order, repeating.
CYCLE = (5.0, 2.0, 1.0)
BINS = 1 << 12


def size_of(text: Column) -> Column:
    """Number of words cut at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 1: half the share of distinct words, plus one half. Between these bounds keys spread evenly over the bins."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SPACE_WORD})"), F.lit(1))
    return F.lit(0.5) + F.lit(0.5) * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))


def survival(doc_id: Column, weight: Column) -> Column:
    """exp of minus the exponential key, u^(1/weight): the largest comes first."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/mix"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.pow(u, F.lit(1.0) / weight)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source_key, source, source_size) and target: shares by weight, capped, the excess reshared by weight.

    A cap of size over weight is reached in ascending order of that ratio, so running sums in this order give the fixed point at
    once. One row a source goes through the windows, never the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (rank % len(cycle) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(after))
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    # Full sources come first and the level rises over them; from the first that isn't full on it falls.
    free = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.select("source_key", "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(free * F.col("w")).alias("target"))


#: Up to so many sources their plan is broadcast (some 100 bytes each); beyond it Spark joins by source.
MANY_SOURCES = 10_000


def numbers(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, key, bin): what the plan needs of each document, without its text."""
    w = quality_weight(F.col("text")) if weight is None else weight
    d = docs.select("doc_id", source_key(), size_of(F.col("text")).alias("size"), survival(F.col("doc_id"), w).alias("key"))
    return d.withColumn("bin", bin_of(F.col("key")))


def source_key() -> Column:
    """A source with null as a value of its own."""
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key")


def bin_of(key: Column) -> Column:
    return F.floor((F.lit(1.0) - key) * BINS).cast("int")


def plan_mix(nums: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source_key, source_size, target, epochs, cut_bin, cut.

    After the epochs a document is taken if its bin comes before cut_bin, or is cut_bin and (-key, doc_id) comes before cut (null:
    the whole bin). The first document of which less than half fits into the budget ends the selection.
    """
    bins = nums.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    sums = bins.groupBy("source_key").agg(F.sum("bin_size").alias("source_size"))
    goal = targets(sums.select("source_key", F.when(~F.col("source_key.none"), F.col("source_key.name")).alias("source"), "source_size"), share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    before = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    running = bins.withColumn("ahead", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(small(goal.select("source_key", "budget")), "source_key")
    over = running.where(F.col("ahead") + F.col("bin_size") > F.col("budget")).groupBy("source_key").agg(F.min(F.struct("bin", "ahead", "budget")).alias("at"))
    over = stored(over.select("source_key", F.col("at.bin").alias("bin"), F.col("at.ahead").alias("ahead"), F.col("at.budget").alias("budget")))
    edge = nums.join(small(over), ["source_key", "bin"])
    order = Window.partitionBy("source_key").orderBy(F.col("key").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("sum", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = edge.where(F.col("sum") + F.col("size") / 2 > F.col("budget")).groupBy("source_key").agg(F.min(F.struct((-F.col("key")).alias("key"), "doc_id")).alias("cut"))
    return goal.join(over.select("source_key", F.col("bin").alias("cut_bin")), "source_key", "left").join(cut, "source_key", "left").drop("budget", "source")


def small(plan: DataFrame) -> DataFrame:
    """plan, broadcast if it has at most MANY_SOURCES rows."""
    return F.broadcast(plan) if plan.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES else plan


def times(key: Column, doc_id: Column, bin_: Column) -> Column:
    """Copies of a document that the mix takes: the epochs, and one more if it comes before the cut of its source."""
    inside = (bin_ == F.col("cut_bin")) & (F.col("cut").isNull() | (F.struct((-key).alias("key"), doc_id.alias("doc_id")) < F.col("cut")))
    return F.col("epochs") + F.coalesce((bin_ < F.col("cut_bin")) | inside, F.lit(False)).cast("long")


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, times (copies the mix takes) and taken (words, repeats counted) of every document.

    weight: a column of quality weights in 0.5..1, by default from the text. A null source is a source of its own, the last one; a
    source without words has target 0; a document without words counts nothing; repeated rows are drawn alike; null ids hash as
    the empty string; an empty table gives no rows. Other columns of docs are not read.
    """
    nums = stored(numbers(docs, weight))
    plan = stored(plan_mix(nums, share, most))
    d = nums.join(small(plan), "source_key").withColumn("times", times(F.col("key"), F.col("doc_id"), F.col("bin")))
    return d.select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they were, whatever their names.

    A null source is a source of its own; null and empty texts count nothing and come with their source's epochs; null ids hash as
    the empty string; repeated rows are drawn alike; an empty table gives no rows.
    """
    plan = stored(plan_mix(stored(numbers(docs)), share, most))
    key = survival(F.col("doc_id"), quality_weight(F.col("text")))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(own, source_key(), F.col("doc_id").alias("id"), key.alias("key")).withColumn("bin", bin_of(F.col("key"))).join(small(plan), "source_key")
    d = d.select("row", F.explode(F.array_repeat(F.lit(0), times(F.col("key"), F.col("id"), F.col("bin")).cast("int"))))
    return d.select("row.*")


def op4_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")

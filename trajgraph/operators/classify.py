"""Classification metrics by key (an atlas, a language, ...): one count of (true, pred) pairs, everything else from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ignore_labels(df: DataFrame, true: str, labels: list) -> DataFrame:
    return df.where(~F.col(true).isin(*labels)) if labels else df


def accuracy(df: DataFrame, true: str, pred: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, true: str, pred: str, keys: list[str]) -> DataFrame:
    """(keys, label, tp, support, predicted, precision, recall, f1); precision of a label never predicted and recall of one never
    true are null, f1 never."""
    pairs = df.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col(true).alias("label"), F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))))
    s = pairs.select(*keys, sides.alias("x")).select(*keys, "x.*").groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    return s.select("*", F.try_divide("tp", "predicted").alias("precision"), F.try_divide("tp", "support").alias("recall"), (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f1"))


def macro(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the labels for which a score is defined."""
    return classes.groupBy(*keys).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def weighted(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Means weighted by support over the labels for which a score is defined."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum(F.when(F.col(c).isNotNull(), F.col("support")))).alias(f"weighted_{c}")
    return classes.groupBy(*keys).agg(*[mean(c) for c in ("precision", "recall", "f1")])


def confusion(df: DataFrame, true: str, pred: str, keys: list[str]) -> DataFrame:
    """(keys, true, pred, n, share): shares of a true label's rows."""
    n = df.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "true")))


def classification_metrics(df: DataFrame, true: str, pred: str, keys: list[str], ignore: list | None = None) -> DataFrame:
    """Accuracy, macro and weighted scores in one row a key; rows whose true label is in ignore are left out."""
    kept = ignore_labels(df, true, ignore or [])
    classes = per_class(kept, true, pred, keys)
    return accuracy(kept, true, pred, keys).join(macro(classes, keys), keys).join(weighted(classes, keys), keys)

"""Cleaning, thresholds, splits and histograms of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rare_labels_fit(df: DataFrame, label: str, subject: str, percent: float) -> DataFrame:
    """(label): labels of fewer than percent % of the subjects."""
    n = df.agg(F.countDistinct(subject).alias("_n"))  # one row
    seen = df.groupBy(label).agg(F.countDistinct(subject).alias("_k"))
    return seen.crossJoin(F.broadcast(n)).where(F.col("_k") < percent / 100 * F.col("_n")).select(label)


def rare_labels_apply(df: DataFrame, rare: DataFrame, label: str) -> DataFrame:
    """Rare labels become 0; rare must come from a fit."""
    if rare is None:
        raise ValueError("no list of rare labels: fit it on the training rows first")
    marks = rare.select(label).distinct().withColumn("_rare", F.lit(True))
    return df.join(marks, label, "left").withColumn(label, F.when(F.col("_rare"), F.lit(0)).otherwise(F.col(label))).drop("_rare")


def split_counts(n: Column, test: float, validation: float) -> tuple[Column, Column]:
    """Rounded up at both levels: rows of test, then of validation among the rest, as 1 - train and its share say."""
    held = F.ceil(n * F.lit(test + validation))
    last = F.ceil(held * F.lit(test / (test + validation)))
    return held.cast("long"), last.cast("long")


def split_by_subject(df: DataFrame, subject: str, order: Column, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2)) -> DataFrame:
    """df with `split`: whole subjects to train, val and test by their rank in `order` (a hash of the subject).

    Only the distinct subjects are ranked.
    """
    held = 1 - ratios[0]  # 0.30000000000000004 for 0.7: one subject of a hundred more than 30
    test = ratios[2] / (ratios[1] + ratios[2])
    subjects = df.select(subject).distinct()
    ranked = subjects.withColumn("_k", F.row_number().over(Window.orderBy(order, subject))).crossJoin(F.broadcast(subjects.agg(F.count(F.lit(1)).alias("_n"))))
    rest = F.ceil(F.col("_n") * F.lit(held))
    last = F.ceil(rest * F.lit(test))
    split = F.when(F.col("_k") <= F.col("_n") - rest, "train").when(F.col("_k") <= F.col("_n") - last, "val").otherwise("test")
    return df.join(ranked.select(subject, split.alias("split")), subject)


def select_subjects(df: DataFrame, subjects: DataFrame, subject: str) -> DataFrame:
    return df.join(subjects, subject, "left_semi")


def class_histogram(df: DataFrame, label: str, dimension: DataFrame) -> DataFrame:
    """(label, n) of every label of the dimension, zeros included."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return dimension.select(F.col("label").alias(label)).join(n, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def label_coverage(df: DataFrame, label: str, n_labels: int) -> DataFrame:
    return df.agg((F.countDistinct(label) / F.lit(n_labels)).alias("coverage"))


def alignment_check(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Subjects whose rows differ in number between sources, with the numbers."""
    out = None
    for name, df in sources.items():
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, key, "full")
    out = out.na.fill(0, list(sources))
    return out.where(F.array_max(F.array(*sources)) != F.array_min(F.array(*sources)))


def subject_index(df: DataFrame, subject: str) -> DataFrame:
    """df with `subject_index`, dense from 0 in the order of subjects; the distinct subjects alone are ranked."""
    index = df.select(subject).distinct().withColumn("subject_index", F.row_number().over(Window.orderBy(subject)) - 1)
    return df.join(index, subject)


def argmax_label(scores: Column) -> Column:
    """Position from 0 of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

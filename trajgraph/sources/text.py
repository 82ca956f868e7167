"""Text sources: label pairs, labels, per-streamline values, matrices, subject lists and artifact names.

A text line has no number in Spark. `lines` numbers the lines of each file at ingest; every reader keeps that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): lines of text files (folders too) in order, from 0.

    Files are read in splits of any number: a line's place among those of its split comes from the order in which a task reads them,
    and the lines of the splits before it are counted first. No file has to fit into a task, and no line is shuffled: the counts, one
    row a split, of which the driver has the list anyway, go to every task.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    splits = rows.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def _clean(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\r\t]", " "))


def parse_label_pairs(text: DataFrame) -> DataFrame:
    """(file, ordinal, node_a, node_b): lines of two integers cut at blanks or commas; comments, short and other lines are left
    out; the ordinal counts kept lines."""
    parts = F.split(_clean(F.col("value")), r"[\s,]+")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    kept = text.where(~F.col("value").startswith("#")).select("file", "line", a.alias("node_a"), b.alias("node_b")).dropna(subset=["node_a", "node_b"])
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).select("file", "ordinal", "node_a", "node_b")


def parse_int_labels(text: DataFrame) -> DataFrame:
    """(file, ordinal, label): one integer a line that isn't blank."""
    kept = text.where(_clean(F.col("value")) != "").select("file", "line", _clean(F.col("value")).try_cast("int").alias("label"))
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).select("file", "ordinal", "label")


def parse_metric(text: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, ordinal, value) for every expected ordinal of a file (expected: file, n).

    Values may stand on one line or many; lines that begin with # are left out; nan and anything else that is no number is null;
    values beyond n are cut off, missing ones are null, and all are null if fewer than half of n are there.
    """
    tokens = text.where(~F.trim("value").startswith("#") & (_clean(F.col("value")) != "")).select("file", "line", F.posexplode(F.split(_clean(F.col("value")), r"\s+")).alias("k", "token"))
    number = F.col("token").try_cast("double")
    numbered = tokens.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line", "k")) - 1).alias("ordinal"), F.when(~F.isnan(number), number).alias("value"))
    n = numbered.groupBy("file").agg(F.count(F.lit(1)).alias("_got"))
    all_ = expected.select("file", "n", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).alias("ordinal"))
    joined = all_.join(numbered, ["file", "ordinal"], "left").join(n, "file", "left")
    return joined.select("file", "ordinal", F.when(F.coalesce("_got", F.lit(0)) >= 0.5 * F.col("n"), F.col("value")).alias("value"))


def parse_matrix(text: DataFrame, index_column: bool = False) -> DataFrame:
    """(file, i, j, w): cells that aren't 0 of the upper triangle, from 1; commas or blanks between them; nan is 0."""
    cells = F.split(_clean(F.col("value")), r"\s*,\s*|\s+")
    if index_column:
        cells = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    rows = text.where(_clean(F.col("value")) != "").select("file", F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("i"), cells.alias("cells"))
    w = F.coalesce(F.nanvl(F.col("token").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    out = rows.select("file", "i", F.posexplode("cells").alias("j", "token")).select("file", "i", (F.col("j") + 1).alias("j"), w.alias("w"))
    return out.where((F.col("i") <= F.col("j")) & (F.col("w") != 0))


def parse_subjects(text: DataFrame, most: int | None = None, directories: bool = False) -> DataFrame:
    """(subject_id): trimmed lines that aren't blank, the first `most` in order; directories: only names of six digits."""
    s = text.select("line", _clean(F.col("value")).alias("subject_id")).where(F.col("subject_id") != "")
    s = s.where(F.col("subject_id").rlike("^[0-9]{6}$")) if directories else s
    return (s.orderBy("line").limit(most) if most else s).select("subject_id")


def pick_source(candidates: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """Of the candidates (keys, priority, path) of each key the one of the least priority, or of the largest with last."""
    best = F.max_by("path", "priority") if last else F.min_by("path", "priority")
    return candidates.groupBy(*keys).agg(best.alias("path"))


def parse_artifact_name(path: Column) -> dict[str, Column]:
    """Subject, version, weighting, atlas and session of a path; the longer atlas name is looked for first."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return {
        "subject_id": F.regexp_extract(path, r"(?:^|/)([0-9]{6})(?:/|_|$)", 1),
        "version": F.when(name.contains("pred"), "pred").otherwise("true"),
        "ctype": F.when(name.rlike("_fa[_.]"), "fa").when(name.rlike("_md[_.]"), "md").when(name.rlike("_ad[_.]"), "ad").when(name.rlike("_rd[_.]"), "rd").when(name.contains("sift"), "sift2").otherwise("nos"),
        "atlas": F.when(name.contains("aparc.a2009s+aseg"), "aparc.a2009s+aseg").when(name.contains("aparc+aseg"), "aparc+aseg"),
        "session": F.when(F.lower(path).contains("retest"), "retest").otherwise("test"),
    }

"""Sinks: dense matrices, predictions, label files, result tables, reports and appended splits."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajgraph.functions.labels import decode_symmetric, encode_symmetric, settled
from trajgraph.functions.tables import create, file_system, kept, names_in
from trajgraph.operators.compare import densify


def matrix_lines(e: DataFrame, keys: list[str], n: int, digits: int | None = 6) -> DataFrame:
    """(keys, row, line): the full symmetric matrix as comma-separated lines, with so many digits or in full precision.

    Halves of the last digit go away from 0; which cells are halves is told at four digits more.
    """
    upper = densify(e, keys, n)
    full = upper.select(*keys, F.col("i").alias("row"), F.col("j").alias("col"), "w").union(upper.where(F.col("i") < F.col("j")).select(*keys, "j", "i", "w"))
    text = F.col("w").cast("string") if digits is None else F.format_string(f"%.{digits}f", F.round(settled(F.col("w"), digits + 4), digits))
    lists = full.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("text")))).alias("cells"))
    return lists.select(*keys, "row", F.array_join(F.transform("cells", lambda c: c["text"]), ",").alias("line"))


def write_matrices(e: DataFrame, keys: list[str], n: int, path: str, digits: int | None = 6) -> None:
    """A folder for each key with the lines of its matrix in order."""
    matrix_lines(e, keys, n, digits).repartition(*keys).sortWithinPartitions(*keys, "row").drop("row").write.partitionBy(*keys).text(path)


def prediction_lines(df: DataFrame, id_: str, label: str, n: int) -> DataFrame:
    """(id, decoded "a b", encoded) lines; labels that can't be decoded have none."""
    a, b = decode_symmetric(F.col(label), n)
    return df.select(id_, F.concat_ws(" ", a, b).alias("decoded"), F.col(label).cast("string").alias("encoded")).where(F.col("decoded") != "")


def write_predictions(df: DataFrame, keys: list[str], id_: str, label: str, n: int, path: str) -> None:
    """Folders `decoded` and `encoded` with one for each key, its lines in order of the id."""
    # Stored, so that both are written from one run of what df comes from.
    stored = kept(df.select(*keys, id_, label))
    for name in ("decoded", "encoded"):
        rows = prediction_lines(stored.select(F.struct(*keys, id_).alias("_row"), label), "_row", label, n).select("_row.*", name)
        rows.repartition(*keys).sortWithinPartitions(*keys, id_).select(*keys, name).write.partitionBy(*keys).text(f"{path}/{name}")


def encode_lines(pairs: DataFrame, n: int) -> DataFrame:
    """Label pairs (file, ordinal, node_a, node_b) as encoded lines; pairs outside are rejected."""
    return pairs.select("file", "ordinal", encode_symmetric(F.col("node_a"), F.col("node_b"), n).cast("string").alias("line")).where(F.col("line").isNotNull())


def decode_lines(labels: DataFrame, n: int) -> DataFrame:
    a, b = decode_symmetric(F.col("label"), n)
    return labels.select("file", "ordinal", F.concat_ws(" ", a, b).alias("line")).where(F.col("line") != "")


def write_results(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def clean_numbers(df: DataFrame, keys: list[str], columns: list[str], numbers: list[str]) -> DataFrame:
    """(keys, columns), nan as null."""
    return df.select(*keys, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) if c in numbers else F.col(c) for c in columns])


def summary(numbers: list[str]) -> Column:
    """A struct with a summary of each numeric column."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q(c)[0].alias("q25"), q(c)[1].alias("median"), q(c)[2].alias("q75"), F.max(c).alias("max"), F.count(c).alias("count")).alias(c) for c in numbers])


def report(df: DataFrame, keys: list[str], columns: list[str], numbers: list[str]) -> DataFrame:
    """(keys, json): one nested document a key with the number of records, a summary of each numeric column and the records; nan is
    null. The records of a key are one document, so they must fit one row; write_reports has no such bound."""
    records = F.sort_array(F.collect_list(F.struct(*columns))).alias("records")
    return clean_numbers(df, keys, columns, numbers).groupBy(*keys).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), summary(numbers).alias("summary"), records)).alias("json"))


def report_lines(df: DataFrame, keys: list[str], columns: list[str], numbers: list[str]) -> DataFrame:
    """(keys, part, columns, line): the same documents in lines, of any size: a head with number and summary (part 0), a line a record
    (part 1, to be ordered by the columns; all but the first begin with a comma) and a tail (part 2)."""
    # Stored, so that the numbers that tell equal records apart stay.
    rows = kept(clean_numbers(df, keys, columns, numbers).withColumn("_id", F.monotonically_increasing_id()))
    head = F.to_json(F.struct(F.count(F.lit(1)).alias("n"), summary(numbers).alias("summary")), {"ignoreNullFields": "false"})
    heads = kept(rows.groupBy(*keys).agg(head.alias("_head"), F.min_by("_id", F.struct(*columns, "_id")).alias("_first")))
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]
    opening = heads.select(*keys, F.lit(0).alias("part"), *none, F.lit(-1).cast("long").alias("_id"), F.concat(F.regexp_replace("_head", r"\}$", ""), F.lit(',"records":[')).alias("line"))
    closing = heads.select(*keys, F.lit(2).alias("part"), *none, F.lit(-1).cast("long").alias("_id"), F.lit("]}").alias("line"))
    record = F.concat(F.when(F.col("_id") == F.col("_first"), "").otherwise(","), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    between = rows.join(heads.select(*[F.col(k).alias(k) for k in keys], "_first"), keys).select(*keys, F.lit(1).alias("part"), *columns, "_id", record.alias("line"))
    return opening.unionByName(between).unionByName(closing)


def write_reports(df: DataFrame, keys: list[str], columns: list[str], numbers: list[str], path: str) -> None:
    """A folder for each key; the lines of its files, in order of their names, are one JSON document.

    Lines are dealt by ranges of (keys, part, columns), so a document of any size spreads over tasks and files.
    """
    order = [*keys, "part", *columns, "_id"]
    lines = report_lines(df, keys, columns, numbers)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*keys, "line").write.partitionBy(*keys).text(path)


def equal_counts(features: DataFrame, labels: DataFrame, subject: str) -> DataFrame:
    """The rows of features whose subject has as many rows in labels."""
    count = lambda df, name: df.groupBy(subject).agg(F.count(F.lit(1)).alias(name))
    same = count(features, "_n").join(count(labels, "_m"), subject).where(F.col("_n") == F.col("_m")).select(subject)
    return features.join(same, subject, "left_semi")


def partition_by_label(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows with a label other than Other; with a path they are written, a folder for each label."""
    named = df.where(F.col(name) != "Other")
    if path:
        named.write.partitionBy(name).parquet(path)
    return named


def append_splits(df: DataFrame, path: str) -> None:
    """Rows with a column `split` appended to its folders."""
    df.write.mode("append").partitionBy("split").parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Number, total length and a hash of the names, lengths and times of all files below some paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    n, size, mixed = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{n}-{size or 0}-{(mixed or 0) & ((1 << 64) - 1):016x}"


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """The table at a path; computed and written first if there is none that can be trusted, or with force.

    A table is written to a staging folder, gets a commit record with a hash of its schema and the fingerprint of the files of
    `inputs`, and is then renamed to its place, so a folder that was left half-written has no record. A stored table is read again
    only if its record names the schema that compute would give (it is planned, not run) and the same inputs.
    """
    table = compute()
    shape = hashlib.sha256(table.schema.json().encode()).hexdigest()[:16]
    record = f"commit-{shape}-{fingerprint(spark, inputs) if inputs else 'none'}"
    if not force and record in names_in(spark, path):
        return spark.read.schema(table.schema).parquet(f"{path}/data")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    table.write.parquet(f"{staging}/data")
    create(spark, f"{staging}/{record}")
    fs, at = file_system(spark, path)
    fs.delete(at, True)
    if not fs.rename(file_system(spark, staging)[1], at):
        raise OSError(f"{staging} can't be renamed to {path}")
    return spark.read.schema(table.schema).parquet(f"{path}/data")

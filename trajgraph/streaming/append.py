"""Incremental append of subject chunks to the splits, each row once.

A batch of the stream writes to folders of its own and is committed by one empty file in the manifest, whose name says everything:
place, stream, batch, folder, and whether it released rows. Readers follow the manifest. A batch that was stopped before its commit
is taken again from the start, and what it left behind is in no manifest; one that was stopped after it is passed over.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajgraph.functions.tables import create, names_in


@dataclass(frozen=True)
class Batch:
    """A committed batch."""

    place: int
    stream: str
    number: int
    folder: str
    released: bool

    @property
    def name(self) -> str:
        return f"{self.place:010d}.{self.stream}.{self.number}.{self.folder}.{int(self.released)}"


def manifest(spark: SparkSession, path: str) -> list[Batch]:
    """The committed batches in order."""
    parts = [x.split(".") for x in names_in(spark, f"{path}/manifest")]
    return [Batch(int(p[0]), p[1], int(p[2]), p[3], p[4] == "1") for p in parts]


def commit(spark: SparkSession, path: str, batch: Batch) -> None:
    create(spark, f"{path}/manifest/{batch.name}")


def read_part(spark: SparkSession, path: str, batches: list[Batch], part: str) -> DataFrame:
    """A part of some batches, with the place of each row's batch."""
    tables = [spark.read.parquet(f"{path}/data/{b.folder}/{part}").withColumn("_place", F.lit(b.place)) for b in batches]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def take(batch_rows: DataFrame, number: int, stream: str, splits: DataFrame, subject: str, path: str, reconcile: bool) -> None:
    """One batch (rows with a column `_label`): counts and rows are stored, rows of subjects whose counts agree are released.

    Without reconcile all rows are released. A subject whose counts agree may get more rows later: they wait until its counts agree again.
    """
    spark = batch_rows.sparkSession
    before = manifest(spark, path)
    if any((b.stream, b.number) == (stream, number) for b in before):
        return
    batch = Batch(before[-1].place + 1 if before else 0, stream, number, uuid.uuid4().hex, False)
    at = f"{path}/data/{batch.folder}"
    batch_rows.where(~F.col("_label")).drop("_label").write.parquet(f"{at}/waiting")
    every = [*before, batch]
    waiting = read_part(spark, path, every if reconcile else [batch], "waiting")
    if reconcile:
        one = lambda c: F.sum(c.cast("long"))
        batch_rows.groupBy(subject).agg(one(~F.col("_label")).alias("rows"), one(F.col("_label")).alias("labels")).write.parquet(f"{at}/counts")
        agree = read_part(spark, path, every, "counts").groupBy(subject).agg(F.sum("rows").alias("rows"), F.sum("labels").alias("labels"), F.max("_place").alias("_last"))
        past = [b for b in before if b.released]
        agree = agree.where((F.col("rows") == F.col("labels")) & (F.col("_last") == batch.place)).select(subject)
        agree.write.parquet(f"{at}/released")
        ready = spark.read.parquet(f"{at}/released")
        if past:
            last = read_part(spark, path, past, "released").groupBy(subject).agg(F.max("_place").alias("_since"))
            # Stored like the released subjects, so that their size is known: a few go to every task, and no waiting row is shuffled.
            ready.join(last, subject, "left").write.parquet(f"{at}/since")
            ready = spark.read.parquet(f"{at}/since")
        waiting = waiting.join(ready, subject).where(F.col("_place") > F.coalesce("_since", F.lit(-1)) if past else F.lit(True)).drop("_since")
    out = waiting.drop("_place").join(splits, subject)
    any_ = out.limit(1).count() > 0
    if any_:
        out.write.partitionBy("split").parquet(f"{at}/rows")
    commit(spark, path, Batch(batch.place, stream, number, batch.folder, any_))


def append_stream(spark: SparkSession, source: str, schema: StructType, splits: DataFrame, subject: str, path: str, checkpoint: str, labels: str | None = None, label_schema: StructType | None = None) -> None:
    """New files of `source` go to the split of their subject (splits: subject, split); files already taken are not read again.

    labels: a folder with a file row a label, its subject among the columns; then rows of a subject wait, in stored batches, until it
    has as many rows as labels. One stream at a time may append to a path.
    """
    chunks = spark.readStream.schema(schema).parquet(source).withColumn("_label", F.lit(False))
    if labels is not None:
        told = spark.readStream.schema(label_schema).parquet(labels).select(subject).withColumn("_label", F.lit(True))
        chunks = chunks.unionByName(told, allowMissingColumns=True)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    each = lambda df, number: take(df, number, stream, splits, subject, path, labels is not None)
    query = chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """The released rows of all committed batches."""
    return read_part(spark, path, [b for b in manifest(spark, path) if b.released], "rows").drop("_place")


def counts_by_split(spark: SparkSession, path: str) -> DataFrame:
    return read_splits(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))

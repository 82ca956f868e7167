"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that cut at ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch: whole texts, of which some are very long, so that a Python worker holds a few MB of most batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that a Python worker holds at once, for this session, unless a smaller bound is set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the whole cluster sees; in local mode a temporary one where it is unset."""
    small_batches(spark)
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        there = spark.sparkContext.getCheckpointDir()
    return there


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, compressed, safe from lost executors, lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many rows (a few hundred bytes each at most) a table is broadcast; beyond it Spark joins by key.
FEW_ROWS = 200_000


def small(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A table of short rows, broadcast if it has at most `most` of them."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Keys with more rows than HOT_ROWS are joined in SALTS parts, or broadcast where they are few.
HOT_ROWS, SALTS = 1000, 64


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, spread: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with a table of one row a key, in which the rows of a frequent key never meet in one task.

    count: the table's column with (at least) the number of rows of a key; spread: a column of rows that differs within a key.
    """
    many = table.where(F.col(count) > hot)
    if many.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        first = rows.join(F.broadcast(many), on, "left")
    else:
        salted = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        first = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], "left").drop("_salt")
    rest = first.where(F.col(count).isNull()).select(*rows.columns).join(table.where(F.col(count) <= hot), on)
    return first.where(F.col(count).isNotNull()).unionByName(rest)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def labelled_ids(labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """(doc_id, y) of at most max_rows labelled ids: all of them, or those of the smallest hashes.

    keep: a condition on doc_id. Rows without id or label are left out; repeated labels of an id are averaged.
    """
    ids = labels.select("doc_id", F.col(label).cast("double").alias("y")).dropna().where(keep).groupBy("doc_id").agg(F.avg("y").alias("y"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the public SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: One random 64-bit number for each byte, and an odd multiplier with its inverse modulo 2^64.
BYTE_CODES = splitmix(np.arange(256, dtype=np.uint64))
BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept, as every batch needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Rolling:
    """Hashes of any stretches of a byte array, by one running sum."""

    def __init__(self, codes: np.ndarray):
        """codes: a random number for each element."""
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * powers(BASE, len(codes)), out=self.sums[1:])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), alike for alike contents at any place; the lengths count too."""
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * powers(BASE_INVERSE, len(self.sums))[start]
            return splitmix(raw + (end - start).astype(np.uint64))

    def fixed(self, k: int) -> np.ndarray:
        """Hashes of the k elements from each place on."""
        raw = (self.sums[k:] - self.sums[:-k]) * powers(BASE_INVERSE, len(self.sums))[: len(self.sums) - k]
        return splitmix(raw)


def groups_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Neighbouring rows in groups of about `most` in total; a larger row stands alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return [*out, (begin, len(sizes))] if sizes else []

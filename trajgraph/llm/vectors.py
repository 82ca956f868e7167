"""Whole-number vectors for the searches: rows that take part, equal rows as one with their number, and best rows by score."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajgraph.llm.common import stored

#: Rows of a block: 64 components of 8 bytes make 16 MB. Small tables are dealt to more blocks of at least LEAST_ROWS, so that all cores work.
BLOCK_ROWS, LEAST_ROWS = 32_768, 2048


def whole(vector: Column, scale: float) -> Column:
    """Each component x as floor(scale * x), x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def complete(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components (an empty vector is complete)."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def classes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n, twin): equal rows once, with their number, and a hash of all but the first column (the id) that tells rows of one id apart; stored.

    A row that stands a million times is counted before the shuffle and is one row from here on.
    """
    return stored(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("twin", F.xxhash64(*columns[1:])))


def blocks_of(n: int, parallel: int, most: int = BLOCK_ROWS, least: int = LEAST_ROWS) -> int:
    """Number of blocks of n rows: of `most` rows at most on average, and as many as there are cores if blocks stay over `least`."""
    return max(1, -(-n // most), min(parallel, n // least))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists as an integer matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def narrow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int32 if no inner product of their rows can pass 31 bits."""
    most = lambda m: int(np.abs(m).max(initial=0))
    return (a.astype(np.int32), b.astype(np.int32)) if most(a) * most(b) * max(1, a.shape[1]) < 1 << 31 else (a, b)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m
    return pad(a), pad(b)


def ranked(parts: DataFrame, group: list[str], k: int, superblock: str | None = None) -> DataFrame:
    """The k best rows (score down, vec_id up) of each group of the best rows of blocks, with `rank` from 1.

    parts has a column `n`, the number of equal rows that a row stands for: it is dealt out to as many, k at most. With superblock the
    rows of a group meet in two steps, so that very many blocks aren't merged in one task.
    """
    order = [F.col("score").desc(), F.col("vec_id"), F.col("twin")]
    if superblock:
        by = Window.partitionBy(*group, superblock).orderBy(*order)
        parts = parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("rank")
    each = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order, "copy"))).where(F.col("rank") <= k).drop("copy", "n")


def keep_best(group: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries (score down, row up) of each group."""
    order = np.lexsort((row, -score, group))
    group = group[order]
    return order[np.arange(len(order)) - np.searchsorted(group, group) < k]


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def steps_of(n: int, most: int) -> int:
    """Rows of equal parts of n rows, `most` at most."""
    return math.ceil(n / max(1, math.ceil(n / most))) if n else 1

"""Exact top-k search by inner product, term at a time.

Vectors are whole numbers and mostly sparse to the search: a block of candidates becomes an inverted file, one posting list a term
(a position of the vectors) with the rows and weights that aren't 0. The queries of a batch add up one term after another: each
scatters its weight times the posting's weights into its dense array of scores. The k best of each
query are picked by partition, not by sorting, and the blocks' best are merged.

Every block of queries meets every block of candidates in a task of its own, which sends on k rows a query: no pair leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajgraph.llm import vectors as V
from trajgraph.llm.common import read

#: Candidates and queries of a score array: 1 or 2 MB, which stay in a core's cache, as do their products.
CANDIDATES, QUERIES = 4096, 64
#: Blocks of candidates whose best rows are merged before all are.
SUPERBLOCK = 64
#: What a task finds; twin and query_twin tell rows of one id apart, n and copies are the numbers of equal rows.
FOUND = ("query_id", "query_twin", "copies", "vec_id", "twin", "n", "score", "block")


def postings(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, weight): the entries that aren't 0 by column; those of column t are start[t]..start[t + 1], rows ascending."""
    term, row = np.nonzero(m.T)
    return np.searchsorted(term, np.arange(m.shape[1] + 1)), row, m[row, term]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first query, first candidate, scores[candidate, query]) of each batch of queries with each part of the candidates.

    A posting list of more than half of the part's rows is added as a whole column, its zeros included: that is faster than scattering.
    """
    for c in range(0, len(candidates), step := V.steps_of(len(candidates), CANDIDATES)):
        part = candidates[c : c + step]
        start, rows, weights = postings(part)
        columns = {t: np.ascontiguousarray(part[:, t]) for t in np.flatnonzero(2 * np.diff(start) > len(part)).tolist()}
        for q in range(0, len(queries), QUERIES):
            batch = queries[q : q + QUERIES]
            q_start, q_rows, q_weights = postings(batch)
            scores = np.zeros((len(batch), len(part)), dtype=candidates.dtype)
            added = np.empty_like(scores)
            for t in range(batch.shape[1]):
                own, asks = slice(start[t], start[t + 1]), slice(q_start[t], q_start[t + 1])
                if own.start == own.stop or asks.start == asks.stop:
                    continue
                if t in columns and 2 * (asks.stop - asks.start) > len(batch):
                    scores += np.multiply.outer(batch[:, t], columns[t], out=added)
                else:
                    scores[np.ix_(q_rows[asks], rows[own])] += np.multiply.outer(q_weights[asks], weights[own])
            yield q, c, scores.T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each column, the upper row first among equals; in no order. Rows of -inf (the least value of
    the type) are left out."""
    n, k = len(scores), min(k, len(scores))
    least = np.iinfo(scores.dtype).min
    lanes = scores.T.copy()
    lanes.partition(n - k, axis=1)
    kth = lanes[:, n - k]
    row, column = np.nonzero((scores >= kth) & (scores > least))
    # Of those equal to the k-th only the upper ones count.
    over = scores[row, column] > kth[column]
    need = k - np.bincount(column[over], minlength=len(kth))
    tied = np.flatnonzero(~over)
    tied = tied[np.argsort(column[tied], kind="stable")]
    place = np.arange(len(tied)) - np.searchsorted(column[tied], column[tied])
    keep = over
    keep[tied[place < need[column[tied]]]] = True
    return row[keep], column[keep]


def search(rows: DataFrame, k: int, is_query: Column, scale: float, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query (a condition on `vec_id`) the k rows with the largest inner
    product of the whole-number vectors, itself left out; ties go to the smaller id. All if there are fewer.

    Rows without id and vectors that are null or hold null or non-finite components take no part; a shorter vector counts as if it
    ended in zeros, so an empty one scores 0. Rows that repeat an id are rows of their own: each is a candidate of the others, and
    each query row has its k results. Sums beyond 64 bits wrap. An empty table gives no rows. Other columns aren't read.
    """
    whole = rows.where(F.col(id_).isNotNull() & V.complete(F.col(vector))).select(F.col(id_).cast("long").alias("vec_id"), V.whole(F.col(vector), scale).alias("v"))
    all_ = V.classes(whole, ["vec_id", "v"])
    asked = all_.where(is_query)
    parallel = V.cores(rows)
    parts = V.blocks_of(all_.count(), parallel)
    batches = V.blocks_of(asked.count(), 1)
    deal = F.xxhash64("vec_id", "twin")
    left = asked.select("vec_id", "v", "n", "twin", F.pmod(deal, F.lit(batches)).cast("int").alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_c"))
    # Named anew, as both sides are one table.
    right = all_.select(*[F.col(c).alias(c) for c in all_.columns], F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("_q"), F.pmod(deal, F.lit(parts)).cast("int").alias("_c"))

    def work(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.schema([(c, pa.int64()) for c in FOUND]).empty_table()
        c = c.sort_by([("vec_id", "ascending"), ("twin", "ascending")])
        asks, own = V.narrow(*V.same_width(V.matrix(q["v"]), V.matrix(c["v"])))
        name = {s: {n: t[n].to_numpy() for n in ("vec_id", "twin", "n")} for s, t in (("q", q), ("c", c))}
        # The place of each query among the candidates, if it is in this block.
        place = {x: i for i, x in enumerate(zip(name["c"]["vec_id"].tolist(), name["c"]["twin"].tolist(), strict=True))}
        itself = np.array([place.get(x, -1) for x in zip(name["q"]["vec_id"].tolist(), name["q"]["twin"].tolist(), strict=True)], dtype=np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for q0, c0, scores in accumulate(asks, own):
            here = itself[q0 : q0 + scores.shape[1]] - c0
            alone = np.nonzero((here >= 0) & (here < len(scores)))[0]
            alone = alone[name["c"]["n"][here[alone] + c0] == 1]
            scores[here[alone], alone] = np.iinfo(scores.dtype).min
            r, a = best(scores, k)
            out.append((r + c0, a + q0, scores[r, a].astype(np.int64)))
        r, a, score = (np.concatenate(x) for x in zip(*out, strict=True))
        top = V.keep_best(a, score, r, k)
        r, a, score = r[top], a[top], score[top]
        n = name["c"]["n"][r] - (itself[a] == r)
        block = np.full(len(r), key[1].as_py() // SUPERBLOCK)
        found = [name["q"]["vec_id"][a], name["q"]["twin"][a], name["q"]["n"][a], name["c"]["vec_id"][r], name["c"]["twin"][r], n, score, block]
        return pa.table(dict(zip(FOUND, found, strict=True)))

    found = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(work, ", ".join(f"{c} long" for c in FOUND))
    top = V.ranked(found, ["query_id", "query_twin"], k, "block" if parts > SUPERBLOCK else None)
    # A query that stands several times has its results as often.
    return top.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_topk_search(spark, sf_dir):
    return search(read(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0, 64)

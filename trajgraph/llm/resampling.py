"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Features (runs of words) are hashed into buckets. A bucket's gain is the logarithm of how much more of the target's features than of
the documents' fall into it, smoothed by one; the gains are an array, and a document's weight is the sum of the array's values at its
features. Gumbel noise hashed from the id makes the highest scores a draw without replacement in proportion to the weights.

The draw is ordered by the digits of a composite key (score down, id up), the least significant first. Each pass is a counting sort
that keeps the order of equal digits: rows stand in blocks of places, blocks count their digits, prefix sums over (digit, block) give
where the first row of each starts, and a row's destination is that and its number within its block and digit. The last destination
is the rank. Rows that can't be drawn, by a count of scores in bins, are not sorted.

Texts are read and cut once: their buckets are stored, two bytes a feature, for both the counts and the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajgraph.llm.common import read, small, stored

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Bits of a digit at most, rows of a block of places, and bins of the scores.
DIGIT_BITS, BLOCK_ROWS, SCORE_BINS = 16, 1 << 20, 4096
#: Bytes of text that are cut at once.
PIECE_BYTES = 4 << 20

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
_LOWER = bytes(range(256)).lower()
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each stretch [start, end) of the bytes: all stretches go on byte by byte together, those that ended drop out."""
    order = np.argsort(start - end, kind="stable")  # the longest first: those that go on are a prefix
    at, left = start[order], (end - start)[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    going = len(order)
    for k in range(int(left.max(initial=0))):
        going = int(np.searchsorted(-left[:going], -k, side="left"))
        c = crc[:going]
        crc[:going] = _CRC[(c ^ data[at[:going] + k]) & 0xFF] ^ (c >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def runs_of(texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text): all runs of 1 to `most` consecutive words of each text, words parted by one space."""
    data = np.frombuffer(b"\x20".join(texts).translate(_LOWER) + b"\x20", dtype=np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD_BYTE[data])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if most > 1:  # words moved together, one space between them
        size = end - start + 1
        begin = np.cumsum(size) - size
        packed = np.full(int(size.sum()), 0x20, dtype=np.uint8)
        packed[np.arange(len(packed)) - np.repeat(begin, size) < np.repeat(size - 1, size)] = data[_WORD_BYTE[data]]
        of = np.searchsorted(bounds, start, side="right") - 1
        last = np.concatenate([np.arange(len(start)) + k for k in range(most)])
        first = np.tile(np.arange(len(start)), most)
        inside = last < len(start)
        first, last = first[inside], last[inside]
        same = of[first] == of[last]
        first, last = first[same], last[same]
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        return packed, begin[first], (begin + size - 1)[last], of[first]
    return data, start, end, np.searchsorted(bounds, start, side="right") - 1


def bucket_lists(texts: list[str | None], most: int, buckets: int) -> list[np.ndarray]:
    """The buckets of each text's features, as 16-bit (or, with more buckets, 32-bit) numbers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data, start, end, of = runs_of(raw, most)
    bucket = (crc32_runs(data, start, end) % np.uint32(buckets)).astype(kind)
    return np.split(bucket, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def features(rows: DataFrame, most: int = 1, buckets: int = BUCKETS, id_: str | None = "doc_id") -> DataFrame:
    """(doc_id, n_features, n_words, buckets): one row a text, its features' buckets as bytes; a stored table. Without id_, no doc_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts])
            for rows_ in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // PIECE_BYTES)) + 1):
                if len(rows_):
                    lists = bucket_lists([texts[i] for i in rows_], most, buckets)
                    n = np.array([len(b) for b in lists], dtype=np.int64)
                    # Of w words there are w + (w - 1) + ... runs, up to `most` terms; with runs of one word they are as many.
                    words = n if most == 1 else np.array([words_in(int(k), most) for k in n], dtype=np.int64)
                    own = [batch["doc_id"].take(pa.array(rows_))] if id_ else []
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(words), pa.array([b.tobytes() for b in lists], pa.binary())], names)

    names = [*(["doc_id"] if id_ else []), "n_features", "n_words", "buckets"]
    keep = [F.col(id_).cast("long").alias("doc_id")] if id_ else []
    shape = f"{'doc_id long, ' if id_ else ''}n_features long, n_words long, buckets binary"
    return stored(rows.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(cut, shape))


def words_in(n_runs: int, most: int) -> int:
    """Number of words of a text with so many runs of 1 to `most` words."""
    w = 0
    while n_runs > 0:
        w += 1
        n_runs -= min(w, most)
    return w


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket over all rows. A task adds up all its rows in one array and sends that on."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["buckets"].to_pylist()), dtype=kind), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return table.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log) of the smoothed share of the target's features in each bucket over the documents' share: `buckets` numbers."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, own), (t, target)):
        for bucket, n in bucket_counts(table, buckets).collect():
            counts[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(table: DataFrame, sent: Broadcast) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the sum of the gains (sent, an array of a number a bucket) at each row's buckets."""
    kind = np.uint16 if len(sent.value) <= 1 << 16 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate(([0], np.cumsum(sent.value[np.frombuffer(b"".join(batch["buckets"].to_pylist()), dtype=kind)])))
            end = np.cumsum(batch["n_features"].to_numpy())
            weight = sums[end] - sums[end - batch["n_features"].to_numpy()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_features"], batch["n_words"], pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return table.mapInArrow(add, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel draw, hashed from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def digits(part: Column, most: int) -> list[Column]:
    """The digits of whole numbers 0..most, the least significant first, of equal width up to DIGIT_BITS."""
    n = -(-most.bit_length() // DIGIT_BITS)
    width = -(-most.bit_length() // n) if n else 1
    return [F.shiftrightunsigned(part, k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(n)]


def radix_ranks(rows: DataFrame, parts: list[tuple[str, int]], rank: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with their place from 1 in ascending order of parts, the first the most significant.

    parts: columns of whole numbers from 0, and the largest value of each. Equal rows keep the order in which they stand in the
    stored table. Every pass is written, so that a lost executor repeats one pass at most.
    """
    # First places have gaps: the number of a scan's partition is in the upper bits. A scan of a stored table gives them anew alike.
    at = stored(rows).withColumn("_at", F.monotonically_increasing_id())
    for name, most in reversed(parts):
        for digit in digits(F.col(name), most):
            at = at.withColumn("_digit", digit).withColumn("_block", F.floor(F.col("_at") / F.lit(block_rows)))
            counts = stored(at.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n")))
            before = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            # One row a digit, 65,536 at most, goes through the window over all digits.
            first = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
            first = first.withColumn("_first", F.coalesce(F.sum("_all").over(Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            start = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(first.drop("_all")), "_digit")
            own = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_at")) - 1
            moved = at.withColumn("_own", own).join(small(start.select("_digit", "_block", (F.col("_first") + F.col("_before")).alias("_start"))), ["_digit", "_block"])
            at = stored(moved.select(*rows.columns, (F.col("_start") + F.col("_own")).alias("_at")))
    return at.select(*rows.columns, (F.col("_at") + 1).alias(rank))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    A null or empty text has no features, weight 0, and is never drawn (unless least_words is 0). A missing id is hashed as the empty
    string and comes last among equals. Repeated rows are drawn as rows of their own; rows alike in id and score come in the order
    of their number of features. With an empty target all gains come from the documents alone; an empty table gives no rows. Other
    columns aren't read.
    """
    own = features(docs, most, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains(own, features(target, most, buckets, None), buckets))
    scored = stored(weighted(own, sent).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    sent.destroy()
    able = F.col("n_words") >= least_words
    low, high, first, last, longest, n = scored.where(able).agg(F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id"), F.max("n_features"), F.count(F.lit(1))).first()
    drawn = n * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    # Bins of equal width from the highest score down: those before the one in which the draw is full can all be drawn.
    width = (high - low) // SCORE_BINS + 1
    bin_ = F.floor((F.lit(high) - F.col("score")) / F.lit(width))
    counts = sorted(scored.where(able).groupBy(bin_.alias("b")).count().collect())
    cut = counts[int(np.searchsorted(np.cumsum([c for _, c in counts]), drawn))][0]
    near = able & (bin_ <= cut)
    none = (last or 0) - (first or 0) + 1
    keys = [("_score", F.lit(high) - F.col("score"), high - low), ("_id", F.coalesce(F.col("doc_id") - F.lit(first), F.lit(none)), none), ("_size", F.col("n_features"), longest)]
    ranks = radix_ranks(scored.where(near).select(*out, *[c.cast("long").alias(name) for name, c, _ in keys]), [(name, most_) for name, _, most_ in keys])
    ranks = ranks.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranks.unionByName(scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

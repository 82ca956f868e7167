"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels. At each level every child draws ``-ln(u) / weight`` with u hashed from the
child's path and the document's id; the smallest draw wins, so a child gets its share of the weight, and a change of a weight
moves rows only between that child and its siblings. A further shard opens a region of its own: draws of the other regions stay,
so rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int, base: int = 16, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """The first `base` shards fill regions of racks x per_rack; each later one is a region of its own."""
    size, first = racks * per_rack, min(n_shards, base)
    out = [Shard(i // size, i % size // per_rack, i) for i in range(first)]
    regions = -(-first // size)
    return out + [Shard(regions + i, 0, first + i) for i in range(n_shards - first)]


def draw(doc_id: Column, path: Column, weight: Column) -> Column:
    """An exponential draw of rate `weight`, hashed from the node's path and the id (52 bits of MD5)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), path)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def descend(docs: DataFrame, leaves: list[Shard], shard: str = "shard") -> DataFrame:
    """docs with the shard of each id: at each of three levels the children of the branch reached so far draw."""
    weights: dict[str, float] = {}
    for x in leaves:
        for path in (f"{x.region}", f"{x.region}.{x.rack}", f"{x.region}.{x.rack}.{x.shard}"):
            weights[path] = weights.get(path, 0.0) + x.weight
    reached = F.lit("")
    for depth in range(3):
        children: dict[str, list[str]] = {}
        for path in (p for p in weights if p.count(".") == depth):
            children.setdefault(path.rpartition(".")[0], []).append(path)
        known = F.create_map(*[c for parent, own in children.items() for c in (F.lit(parent), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(weights[p]).alias("weight")) for p in own]))])
        draws = F.transform(F.element_at(known, reached), lambda x: F.struct(draw(F.col("doc_id"), x["path"], x["weight"]).alias("draw"), x["path"].alias("path")))
        reached = F.array_min(draws)["path"]
    return docs.withColumn(shard, F.substring_index(reached, ".", -1).cast("int"))


def slots(df: DataFrame, shard: str, order: list[Column], spread: Column, buckets: int = 1024) -> DataFrame:
    """df with `slot`, gapless from 0 in each shard, without ordering a whole shard in one task.

    Rows of a shard are dealt to `buckets` hash buckets; counts of the buckets give each bucket's first slot.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    counts = dealt.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    return dealt.join(first, [shard, "_bucket"]).withColumn("slot", (F.col("_first") + rank - 1).cast("long")).drop("_bucket", "_first")


def shard_documents(docs: DataFrame, n_shards: int = 16, base: int = 16) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Nulls and empty texts: size 1, crc 0; a null id hashes as the empty string; a repeated row gets the same shard and a slot of
    its own; an empty table gives no rows. Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = descend(descend(placed, tree(n_shards, base)), tree(n_shards + 1, base), "grown_shard")
    out = slots(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.struct("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assign_shards(docs: DataFrame, n_shards: int = 16, base: int = 16) -> DataFrame:
    """The documents with a column `shard` (replacing one of that name).

    The shard depends on the id alone: null and empty texts and repeated rows need no care, a null id hashes as the empty string; an
    empty table gives no rows.
    """
    return descend(docs, tree(n_shards, base))


def op6_sharding(spark, sf_dir):
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

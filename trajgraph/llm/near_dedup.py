"""MinHash near-duplicates with min-max hashing.

Every permutation of the word shingles gives two values, its minimum and its maximum, so PERMUTATIONS hash evaluations make twice
as many signature values. Bands of BAND values put documents of like sets into common buckets; a pair at the threshold of 0.8
meets in none of them with a chance of 5e-8. Rows of equal sets are one class and stand as one node; rows meet their class once, at
the end, and classes of many rows meet theirs without a shuffle by class. Links are confirmed on the full sets:

1. a node is compared with one partner: of the smallest nodes of its buckets the one that it shares most buckets with;
2. confirmed links give components;
3. where a bucket still holds several components, nodes across them are compared; pairs within a component need no comparison.
   In small buckets these are pairs that sizes and signatures don't rule out; in large ones the nodes outside a cluster's largest
   component are queries against all its nodes, in blocks. This yields every link that can join two components.

So groups of thousands of copies never make all their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajgraph.llm.common import BYTE_CODES, Rolling, groups_of, join_hot, read, small, splitmix, stored

PERMUTATIONS, BAND = 64, 4
BANDS = 2 * PERMUTATIONS // BAND
#: Pairs whose signatures agree in fewer of 128 values than this are no links (5.4 standard deviations below 0.8).
LEAST_ALIKE = 0.61
#: Buckets of more nodes are worked as clusters in blocks; both ways find every link.
LARGE, BLOCK = 64, 1024
#: Rows of larger classes don't meet in one task.
HOT = 1000
_ODD = splitmix(np.arange(PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
_SHIFT = splitmix(np.arange(PERMUTATIONS, 2 * PERMUTATIONS, dtype=np.uint64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (lower-cased bytes): k words each, or the whole of fewer words."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    white = _WHITE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    words = Rolling(BYTE_CODES[flat]).stretches(starts, ends)
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        factor = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(k)]
        width = max(0, len(words) - k + 1)
        total = sum((words[i : i + width] * factor[i] for i in range(k)), np.full(width, k, dtype=np.uint64))
    whole = doc[:width] == doc[k - 1 :] if width else np.zeros(0, dtype=bool)
    h, owner = splitmix(total[whole]), doc[:width][whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [h[cut[i] : cut[i + 1]] for i in range(len(texts))]
    for i in np.flatnonzero((n > 0) & (n < k)):
        with np.errstate(over="ignore"):
            w = words[first[i] : first[i] + n[i]]
            out[i] = splitmix(np.array([sum((int(x) * int(f) for x, f in zip(w, factor, strict=False)), int(n[i])) & (2**64 - 1)], dtype=np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): the minimum and the maximum of each permutation; no set may be empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(x) for x in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(PERMUTATIONS):
            h = flat * _ODD[j] + _SHIFT[j]
            out[:, 2 * j] = np.minimum.reduceat(h, begin)
            out[:, 2 * j + 1] = np.maximum.reduceat(h, begin)
    return out


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def describe(docs: DataFrame, k: int) -> DataFrame:
    """docs without text, with n, set_hi, set_lo (a 128-bit hash of the set), bands, sketch (2 bytes of each signature value)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [_encoded(t) for t in pdf["text"]]
            for a, b in groups_of([len(t) for t in texts], 700_000):
                sets = shingles(texts[a:b], k)
                n = np.fromiter(map(len, sets), dtype=np.int64, count=b - a)
                some = np.flatnonzero(n)
                bands, sketch, hi, lo = [None] * (b - a), [None] * (b - a), np.zeros(b - a, dtype=np.int64), np.zeros(b - a, dtype=np.int64)
                if len(some):
                    chosen = [sets[i] for i in some]
                    s = signature(chosen)
                    factor = splitmix(np.arange(BAND, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
                    with np.errstate(over="ignore"):
                        keys = splitmix((splitmix(s).reshape(len(some), BANDS, BAND) * factor).sum(2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                        begin = np.cumsum([0] + [len(x) for x in chosen[:-1]])
                        flat = np.concatenate(chosen)
                        hi[some] = np.add.reduceat(splitmix(flat), begin).view(np.int64)
                        lo[some] = np.add.reduceat(splitmix(flat ^ np.uint64(0xABCDEF)), begin).view(np.int64)
                    short = (splitmix(s) & np.uint64(0xFFFF)).astype(np.uint16)
                    for r, i in enumerate(some):
                        bands[i], sketch[i] = keys[r], short[r].tobytes()
                yield pdf.drop(columns="text").iloc[a:b].assign(n=n, set_hi=hi, set_lo=lo, bands=bands, sketch=sketch)

    slim = docs
    shape = slim.drop("text").select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("set_hi"), F.lit(0).cast("long").alias("set_lo"), F.lit(None).cast("array<long>").alias("bands"), F.lit(None).cast("binary").alias("sketch"))
    return slim.mapInPandas(sign, shape.schema)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of each text, 8 bytes each."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [_encoded(t) for t in pdf["text"]]
            for a, b in groups_of([len(t) for t in texts], 700_000):
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "set": [x.tobytes() for x in shingles(texts[a:b], k)]})

    return docs.select("node", "text").mapInPandas(take, docs.select("node", F.lit(b"").alias("set")).schema)


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of agreeing signature values."""
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
    return pd.Series((x == y).mean(1))


@F.pandas_udf(T.BooleanType())
def linked(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    out = []
    for x, y, p in zip(a, b, percent, strict=True):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(x) + len(y) - len(np.union1d(x, y))
        out.append(100 * both >= p * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("b_set"))
    return pairs.join(left, "a").join(right, "b").where(linked("a_set", "b_set", F.lit(percent))).select("a", "b")


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of all nodes that stand in links (a, b): the smallest node reachable.

    Alternating large-star and small-star steps; a step is grouping and windows over the links, and their number never grows. It
    ends when the links are stars: every node points to one other at most, and none that is pointed to points on.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("v").alias("to")))).alias("x")).select("x.*")
        if not ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi")).where(F.col("lo") != F.col("hi")).limit(1).count():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("k"))
        large = join_hot(both, least, ["u"], "k", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("v", "m").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small)
    else:
        raise RuntimeError(f"components of links did not settle in {rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(edges.select("v").distinct().select("v", F.col("v").alias("component")).join(stars.select(F.col("node").alias("v")), "v", "left_anti"))


def across_buckets(small: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes of different components in one small bucket that sizes and signatures don't rule out."""
    left = small.select("band", "key", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_component"))
    right = small.select("band", "key", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_component"))
    sized = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    pairs = left.join(right, ["band", "key"]).where((F.col("a") > F.col("b")) & (F.col("a_component") != F.col("b_component")) & sized).select("a", "b").distinct()
    own = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("a_sketch"))
    other = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("b_sketch"))
    return pairs.join(other, "b").join(own, "a").where(alike("a_sketch", "b_sketch") >= LEAST_ALIKE).select("a", "b")


def across_clusters(large: DataFrame, payload: DataFrame, alike_: Callable[[list[bytes], list[bytes]], np.ndarray], size: int = BLOCK) -> DataFrame:
    """(a, b): links between components of the clusters that large buckets make.

    payload: (node, set), bytes by which nodes are compared; alike_: the payloads of two blocks -> whether each pair is a link. The
    query set of a cluster are its nodes outside its largest component; they are held against all nodes of the cluster, in
    blocks of `size` by `size`, and only links leave a block: for each query one to each other component.
    """
    nodes = stored(large.groupBy("node").agg(F.min("component").alias("component")))
    cluster = stored(components(large.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    placed = stored(nodes.join(cluster.select("node", F.col("component").alias("cluster")), "node"))
    sizes = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.max("c").alias("c"), F.sum("c").alias("m"))
    block = lambda n: F.ceil(n / F.lit(size)).cast("int")
    plan = main.select("cluster", "main", block(F.col("m") - F.col("c")).alias("queries"), block(F.col("m")).alias("blocks"))
    full = placed.join(plan, "cluster").join(payload, "node")
    hashed = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    asked = full.where(F.col("component") != F.col("main")).select("cluster", "node", "component", "set", F.lit(True).alias("query"), hashed(F.col("queries")).alias("q"), F.explode(upto(F.col("blocks"))).alias("b"))
    held = full.where(F.col("queries") > 0).select("cluster", "node", "component", "set", F.lit(False).alias("query"), F.explode(upto(F.col("queries"))).alias("q"), hashed(F.col("blocks")).alias("b"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["query"]], pdf[~pdf["query"]]
        out: list[tuple[int, int]] = []
        if len(x) and len(y):
            cx, cy, ids_x, ids_y = (v.to_numpy() for v in (x["component"], y["component"], x["node"], y["node"]))
            ok = alike_(x["set"].tolist(), y["set"].tolist()) & (cx[:, None] != cy[None, :])
            for r in np.flatnonzero(ok.any(1)):
                cols = np.flatnonzero(ok[r])
                out += [(ids_x[r], ids_y[cols[k]]) for k in np.unique(cy[cols], return_index=True)[1]]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return asked.union(held).groupBy("cluster", "q", "b").applyInPandas(compare, "a long, b long")


def linked_blocks(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """linked for each pair of sets of two blocks."""
    both = _intersections([np.frombuffer(v, dtype=np.uint64) for v in x], [np.frombuffer(v, dtype=np.uint64) for v in y])
    n, m = (np.fromiter(map(len, v), dtype=np.int64, count=len(v)) // 8 for v in (x, y))
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


def linked_components(buckets: DataFrame, confirm_: Callable[[DataFrame], DataFrame], candidates: Callable[[DataFrame], DataFrame], payload: DataFrame, alike_: Callable[[list[bytes], list[bytes]], np.ndarray], size: int = BLOCK) -> DataFrame:
    """(node, component) of the nodes that have a link: components over all links of nodes that share a bucket.

    buckets: stored (band, key, node, least), those of several nodes, and what candidates needs; confirm_: pairs (a, b) -> those that
    are links; candidates: nodes of small buckets of several components -> pairs worth a confirmation; payload, alike_, size:
    see across_clusters, for the large ones.
    """
    stars = buckets.where(F.col("node") != F.col("least")).groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    links = stored(confirm_(best))
    found = stored(components(links))
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
    split = split.where(F.col("lo") != F.col("hi")).select("band", "key", "m")
    open_ = stored(join_hot(placed, split, ["band", "key"], "m", "node"))
    few = candidates(open_.where(F.col("m") <= LARGE))
    many = across_clusters(open_.where(F.col("m") > LARGE), payload, alike_, size)
    more = stored(confirm_(few).union(many))
    return stored(components(links.union(more))) if more.limit(1).count() else found


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, by products of slices of their incidence matrices."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    rows_x, rows_y = (np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (x, y))
    common = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    at_x, at_y = np.searchsorted(common, fx), np.searchsorted(common, fy)
    for a in range(0, len(common), 4096):
        part = common[a : a + 4096]
        mats = []
        for flat, rows, at, n in ((fx, rows_x, at_x, len(x)), (fy, rows_y, at_y, len(y))):
            inside = np.flatnonzero((at >= a) & (at < a + len(part)))
            inside = inside[common[at[inside]] == flat[inside]]
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[rows[inside], at[inside] - a] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out.astype(np.int64)


def text_keys() -> list:
    """Two hashes of a text, 96 bits."""
    return [F.xxhash64("text").alias("copy"), F.hash("text").alias("check")]


CLASS = ["set_hi", "set_lo", "n"]


def classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, copy, check, n, set_hi, set_lo) of docs, n = 0 for empty sets, and classes of those that aren't empty:
    (set_hi, set_lo, n, m, first, component): how many rows, the least (doc_id, copy, check), and the number of its component.

    Of a class and of a component with ids and without the ids come first.
    """
    keyed = docs.select("doc_id", "text", *text_keys())
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    signs = stored(describe(keyed, k).withColumn("row", F.monotonically_increasing_id()))
    some = signs.where(F.col("n") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "check")).alias("first")
    nodes = stored(some.groupBy(*CLASS).agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("m"), first, F.min_by(F.struct(id_.alias("id"), "copy", "check"), "row").alias("text_of")))
    own = some.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = own.select(F.col("row").alias("node"), "n", F.posexplode("bands").alias("band", "key"))
    # The count of a bucket first: most buckets hold one node and end here.
    crowded = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least")).where(F.col("m") > 1)
    buckets = stored(join_hot(banded, crowded, ["band", "key"], "m", "node").select("band", "key", "node", "n", "least"))
    sketches = own.select(F.col("row").alias("node"), "sketch")
    wanted = stored(nodes.join(buckets.select("node").distinct(), "node").select("node", "text_of.*"))
    texts = keyed.withColumn("id", id_).join(small(wanted), ["id", "copy", "check"]).select("node", "text").dropDuplicates(["node"])
    sets = stored(shingle_sets(texts, k))
    found = linked_components(buckets, lambda pairs: confirm(pairs, sets, percent), lambda few: across_buckets(few, sketches, percent), sets, lambda x, y: linked_blocks(x, y, percent))
    of = stored(nodes.join(found, "node", "left")).withColumn("component", F.coalesce("component", "node"))
    return signs.drop("bands", "sketch", "row"), of.select(*CLASS, "m", "first", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are cut at ASCII white space, ASCII letters lower-cased. Null, empty and blank texts have empty sets and stand alone;
    texts of fewer than k words have one shingle, their whole sequence. Repeated rows are copies; rows of one id with different
    texts are linked each by its own text. Rows without an id get the least id that they are linked with, or none, and are kept in
    that case alone. An empty table gives no rows. Other columns of docs are not read.
    """
    rows, of = classes(docs, k, percent)
    least = of.groupBy("component").agg(F.min("first.doc_id").alias("component_id"), F.count(F.lit(1)).alias("k"))
    named = stored(join_hot(of.select(*CLASS, "m", "component"), least, ["component"], "k", "set_lo").select(*CLASS, "m", "component_id"))
    out = join_hot(rows.where(F.col("n") > 0), named, CLASS, "m", "doc_id", HOT).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (that of the smallest id; of repeated rows of it one stays), columns as they were.

    Texts with empty sets stay, of repeated rows of an id one; rows without a doc_id can't be named and stay. Columns of docs may
    have any names; an empty table gives no rows.
    """
    rows, of = classes(docs, k, percent)
    first = of.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.copy", "first.check")
    kept = stored(first.unionByName(rows.where(F.col("n") == 0).select("doc_id", "copy", "check")).where(F.col("doc_id").isNotNull()).distinct())
    copy, check = text_keys()
    on = ["doc_id", "_copy", "_check"]
    named = docs.withColumns({"_copy": copy, "_check": check}).join(kept.select("doc_id", F.col("copy").alias("_copy"), F.col("check").alias("_check")), on, "left_semi").dropDuplicates(on)
    return named.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)

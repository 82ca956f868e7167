"""Hard negatives by a multiway hyperplane tree with ranges (a geometric near-neighbour access tree).

A node of the tree has split points; a row goes to the nearest one, and so down to a leaf. For every two split points p, q of a node
the tree keeps the range of distances from p to the rows below q. A search for rows whose distance to an anchor lies in a window (an
annulus) measures the anchor's distance to each p, and drops q when no row in the range can lie in the annulus. Leaves that stay are
searched exactly.

Scores are inner products. With a coordinate more, sqrt(M - |x|^2) for rows and 0 for anchors (M: the largest |x|^2), a score s lies
at the squared distance |a|^2 + M - 2s, so that windows of scores are windows of distances.

The split points are chosen on a bounded sample; every row is routed, and the ranges are taken over all rows. Leaves larger than a
block are parted, anchors are dealt to blocks, and each visit is a task of one part of a leaf and one block of the anchors that ask
for it. An anchor first visits the part it stands in: the scores found there narrow its windows before the tree is asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajgraph.llm import vectors as V
from trajgraph.llm.common import read, stored
from trajgraph.llm.topk_search import SUPERBLOCK, best

#: Split points of a node, rows that the tree is fitted on, rows of a leaf below which it isn't split, and sampled rows that a split needs.
FAN, SAMPLE, LEAF_ROWS, LEAST_SAMPLE = 8, 4096, 4096, 32
#: Anchors and rows whose scores are held at once.
ANCHORS, ROWS = 128, 4096
NEVER, ALWAYS = -(1 << 62), 1 << 62


@dataclass
class Tree:
    """Nodes as arrays; child[j] >= 0 is a node, child[j] < 0 the leaf -child[j] - 1. low and high[i, j]: distances of split point i to rows below j."""

    largest: float
    points: list[np.ndarray] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    chunks: np.ndarray | None = None

    def apart(self, x: np.ndarray, node: int, lifted: bool = True) -> np.ndarray:
        """Distances of rows (lifted by their own coordinate) or anchors to the split points of a node."""
        p, x = self.points[node], x.astype(np.float64)
        pp, xx = (p * p).sum(1), (x * x).sum(1)
        lift = np.sqrt(np.maximum(self.largest - xx, 0.0)) if lifted else np.zeros(len(x))
        side = np.sqrt(np.maximum(self.largest - pp, 0.0)) - lift[:, None]
        return np.sqrt(np.maximum(xx[:, None] + pp - 2.0 * (x @ p.T) + side * side, 0.0))

    def grow(self, sample: np.ndarray, n: int, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> None:
        """Splits on a sample of n rows: split points are far from each other, the first of a few drawn ones (seeded) again and again."""
        rng = np.random.default_rng(11)
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while todo:
            own, parent, place = todo.pop()
            made = None
            if len(own) >= LEAST_SAMPLE and len(own) * n > leaf_rows * len(sample):
                drawn = sample[rng.choice(own, min(len(own), 4 * fan), replace=False)]
                probe = Tree(self.largest, [drawn.astype(np.float64)])
                between, chosen = probe.apart(drawn, 0), [0]
                while len(chosen) < min(fan, len(drawn)) and (gap := between[chosen].min(0)).max() > 0:
                    chosen.append(int(gap.argmax()))
                if len(chosen) > 1:
                    made = len(self.points)
                    self.points.append(drawn[chosen].astype(np.float64))
                    self.child.append([0] * len(chosen))
                    nearest = self.apart(sample[own], made).argmin(1)
                    todo += [(own[nearest == j], made, j) for j in range(len(chosen))]
            if made is None:
                self.leaves += 1
            if parent >= 0:
                self.child[parent][place] = -self.leaves if made is None else made
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def route(self, x: np.ndarray, ranges: bool = False) -> np.ndarray:
        """The leaf of each row; with ranges, low and high also learn these rows."""
        leaf = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, own = todo.pop()
            d = self.apart(x[own], node)
            nearest = d.argmin(1)
            for j, child in enumerate(self.child[node]):
                below = nearest == j
                if not below.any():
                    continue
                if ranges:
                    self.low[node][:, j] = np.minimum(self.low[node][:, j], d[below].min(0))
                    self.high[node][:, j] = np.maximum(self.high[node][:, j], d[below].max(0))
                if child >= 0:
                    todo.append((child, own[below]))
                else:
                    leaf[own[below]] = -child - 1
        return leaf

    def survivors(self, a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """alive[anchor, leaf]: leaves that may hold a row whose score lies in one of the anchor's windows lo..hi[anchor, window]."""
        aa = (a.astype(np.float64) ** 2).sum(1)[:, None] + self.largest
        rim = lambda s: np.sqrt(np.maximum(aa - 2.0 * np.clip(s.astype(np.float64), -1e30, 1e30), 0.0))
        slack = 1e-5 * np.sqrt(self.largest + aa.max(initial=0.0)) + 1e-9  # of roots of differences of rounded squares
        inner, outer, used = rim(hi) - slack, rim(lo) + slack, lo <= hi
        alive = np.zeros((len(a), max(1, self.leaves)), dtype=bool)
        if not self.points:
            alive[:] = used.any(1)[:, None]
        todo = [(0, np.flatnonzero(used.any(1)))] if self.points else []
        while todo:
            node, own = todo.pop()
            d = self.apart(a[own], node, False)[:, :, None]
            low, high = self.low[node][None], self.high[node][None]
            nearest = np.maximum(np.maximum(low - d, d - high), 0.0).max(1)  # rows below j are at least so far, by some split point
            farthest = (d + high).min(1)
            stay = ((nearest[:, :, None] <= outer[own][:, None, :]) & (farthest[:, :, None] >= inner[own][:, None, :]) & used[own][:, None, :]).any(2) & np.isfinite(low).all(1)
            for j, child in enumerate(self.child[node]):
                if child >= 0:
                    if stay[:, j].any():
                        todo.append((child, own[stay[:, j]]))
                else:
                    alive[own[stay[:, j]], -child - 1] = True
        return alive


def plan(rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = V.BLOCK_ROWS) -> Tree:
    """The tree of a table of classes: split points from `sample` rows of the smallest hashes, ranges and sizes of leaves from all rows.

    What comes to the driver is that sample and a row a split point and subtree, whatever the number of rows.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, largest, width = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    tree = Tree(float(largest or 0))
    drawn = [r[0] for r in rows.orderBy(F.xxhash64("twin", "vec_id"), "vec_id", "twin").select("v").limit(sample).collect()]
    tree.grow(np.array([x + [0] * ((width or 0) - len(x)) for x in drawn], dtype=np.int64).reshape(len(drawn), width or 0), n, leaf_rows)
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        low, high = [np.full_like(a, np.inf) for a in own.low], [np.full_like(a, -np.inf) for a in own.high]
        mine = Tree(own.largest, own.points, own.child, low, high, own.leaves)
        sizes = np.zeros(own.leaves, dtype=np.int64)
        for batch in batches:
            sizes += np.bincount(mine.route(V.same_width(V.matrix(batch["v"]), np.zeros((0, width or 0), dtype=np.int64))[0], True), minlength=own.leaves)
        for k in range(len(mine.points)):
            i, j = np.nonzero(np.isfinite(low[k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i), pa.array(j), pa.array(low[k][i, j]), pa.array(high[k][i, j]), pa.array(np.zeros(len(i), dtype=np.int64))], names)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), -1)), pa.array(np.arange(len(sizes))), pa.array(np.zeros(len(sizes), dtype=np.int64)), pa.array(np.zeros(len(sizes))), pa.array(np.zeros(len(sizes))), pa.array(sizes)], names)

    names = ["node", "i", "j", "low", "high", "n"]
    seen = rows.select("v").mapInArrow(learn, "node long, i long, j long, low double, high double, n long").groupBy("node", "i", "j").agg(F.min("low"), F.max("high"), F.sum("n"))
    tree.chunks = np.zeros(tree.leaves, dtype=np.int64)
    for node, i, j, low, high, size in seen.collect():
        if node < 0:
            tree.chunks[i] = -(-size // block_rows)
        else:
            tree.low[node][i, j], tree.high[node][i, j] = low, high
    sent.destroy()
    return tree


def mine(rows: DataFrame, is_anchor: Column, scale: float, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_: str = "vec_id", vector: str = "embedding", label: Column | str = "label", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = V.BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each row with is_anchor (a condition on `vec_id`).

    Scores are inner products of the whole-number vectors; the larger comes first, then the smaller id. An anchor's positives are its
    first other rows of the same label; of each, the first rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score are returned, so a positive below 0 has none. Fewer rows give what there is.

    Rows without id or label and vectors that are null or hold null or non-finite components take no part; a shorter vector counts as
    if it ended in zeros. Rows that repeat an id are rows of their own, as positives, negatives and anchors. Scores beyond 2^62 wrap.
    An empty table gives no rows. Other columns aren't read.
    """
    label = F.col(label) if isinstance(label, str) else label
    whole = rows.where(F.col(id_).isNotNull() & label.isNotNull() & V.complete(F.col(vector))).select(F.col(id_).cast("long").alias("vec_id"), label.cast("long").alias("label"), V.whole(F.col(vector), scale).alias("v"))
    all_ = V.classes(whole, ["vec_id", "label", "v"])
    tree = plan(all_, sample, leaf_rows, block_rows)
    spark, width = rows.sparkSession, tree.points[0].shape[1] if tree.points else 0
    sent = spark.sparkContext.broadcast(tree)
    wide = lambda m: V.same_width(m, np.zeros((0, width), dtype=np.int64))[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.route(wide(V.matrix(batch["v"])))
            chunk = (batch["twin"].to_numpy() ^ batch["vec_id"].to_numpy()) % np.maximum(sent.value.chunks[leaf], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(chunk)], [*batch.schema.names, "leaf", "chunk"])

    index = stored(all_.mapInArrow(place, "vec_id long, label long, v array<long>, n long, twin long, leaf long, chunk long"))
    anchors = index.where(is_anchor)
    blocks = V.blocks_of(anchors.count(), 1, block_rows)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of leaves that the tree leaves to each anchor, its own part left out."""
        for batch in batches:
            alive = sent.value.survivors(wide(V.matrix(batch["v"])), *windows(batch))
            leaf, chunk = batch["leaf"].to_numpy(), batch["chunk"].to_numpy()
            lists = []
            for row, c, own in zip(leaf, chunk, alive, strict=True):
                at = np.flatnonzero(own)
                lists.append([{"leaf": int(f), "chunk": k} for f in at for k in range(int(sent.value.chunks[f])) if (f, k) != (row, c)])
            kept = [batch[c] for c in ("vec_id", "label", "v", "n", "twin", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(pa.struct([("leaf", pa.int64()), ("chunk", pa.int64())])))], ["vec_id", "label", "v", "n", "twin", "lo", "hi", "to"])

    found = ("anchor_id", "anchor_twin", "window", "vec_id", "twin", "n", "score", "block")

    def visit(asks: DataFrame, same: bool, k: int) -> DataFrame:
        """asks with leaf and chunk: the k best rows of that part in each window, of the same label or of others."""
        left = asks.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "v", "n", "twin", "lo", "hi", "leaf", "chunk")], F.pmod(F.xxhash64("vec_id", "twin"), F.lit(blocks)).cast("int").alias("_a"))
        right = index.select(*[F.col(c).alias(c) for c in index.columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_a"))

        def work(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
            if not len(q) or not len(c):
                return pa.schema([(x, pa.int64()) for x in found]).empty_table()
            c = c.sort_by([("vec_id", "ascending"), ("twin", "ascending")])
            a, x = V.same_width(V.matrix(q["v"]), V.matrix(c["v"]))
            a, x = exact(a, x)
            lo, hi = windows(q)
            ask, row = ({n: t[n].to_numpy() for n in ("vec_id", "twin", "n", "label")} for t in (q, c))
            out: list[np.ndarray] = []
            for a0 in range(0, len(a), ANCHORS):
                at = slice(a0, a0 + ANCHORS)
                for x0 in range(0, len(x), step := V.steps_of(len(x), ROWS)):
                    of = slice(x0, x0 + step)
                    score = (x[of] @ a[at].T).astype(np.int64)
                    itself = (row["vec_id"][of][:, None] == ask["vec_id"][at]) & (row["twin"][of][:, None] == ask["twin"][at])
                    able = ((row["label"][of][:, None] == ask["label"][at]) == same) & ~(itself & (row["n"][of] == 1)[:, None])
                    for w in range(lo.shape[1]):
                        inside = np.where(able & (score >= lo[at, w]) & (score <= hi[at, w]), score, np.iinfo(np.int64).min)
                        r, i = best(inside, k)
                        out.append(np.stack([i + a0, np.full(len(r), w), r + x0, row["n"][r + x0] - itself[r, i], score[r, i]]))
            i, w, r, n, score = np.concatenate(out, axis=1)
            top = V.keep_best(i * lo.shape[1] + w, score, r, k)
            i, w, r, n, score = i[top], w[top], r[top], n[top], score[top]
            columns = [ask["vec_id"][i], ask["twin"][i], w, row["vec_id"][r], row["twin"][r], n, score, np.full(len(r), key[0].as_py() // SUPERBLOCK)]
            return pa.table(dict(zip(found, columns, strict=True)))

        on = ["leaf", "chunk", "_a"]
        parts = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(work, ", ".join(f"{x} long" for x in found))
        return parts

    def first(asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, anchor_twin, window, vec_id, score, rank): the k first rows of each window, over all leaves that may hold one."""
        by = ["anchor_id", "anchor_twin", "window"]
        home = stored(visit(asks, same, k))
        full = home.groupBy(*by).agg(F.sum("n").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        least = full.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_twin").alias("twin")).agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("least"))
        bound = lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("least", w.cast("long")), F.lit(NEVER)))
        narrowed = asks.join(least, ["vec_id", "twin"], "left").withColumn("lo", F.transform("lo", bound))
        asked = narrowed.select("vec_id", "label", "v", "n", "twin", "lo", "hi", "leaf", "chunk").mapInArrow(places, "vec_id long, label long, v array<long>, n long, twin long, lo array<long>, hi array<long>, to array<struct<leaf: long, chunk: long>>")
        rest = visit(asked.withColumn("to", F.explode("to")).select("*", "to.leaf", "to.chunk").drop("to"), same, k)
        return V.ranked(home.unionByName(rest), by, k, "block" if tree.leaves > SUPERBLOCK else None)

    everything = anchors.withColumn("lo", F.array(F.lit(NEVER))).withColumn("hi", F.array(F.lit(ALWAYS)))
    near = first(everything, True, positives)
    near = stored(near.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_twin").alias("twin"), (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    own = near.groupBy("vec_id", "twin").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("p"))  # `positives` a row at most
    edge = lambda share, up: F.transform("p", lambda x: (F.ceil if up else F.floor)(x["positive_score"] * F.lit(share) / F.lit(100)))
    asks = anchors.join(own, ["vec_id", "twin"]).withColumn("lo", edge(low, True)).withColumn("hi", edge(high, False)).drop("p")
    far = first(asks, False, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "anchor_id": "vec_id", "anchor_twin": "twin_"}).drop("twin", "block").withColumnRenamed("twin_", "twin")
    pairs = far.join(near, ["vec_id", "twin", "window"]).join(anchors.select("vec_id", "twin", "n"), ["vec_id", "twin"])
    copies = pairs.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))  # an anchor that stands several times
    return copies.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def windows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi [row, window] of a batch; a row with fewer windows ends in empty ones."""
    lists = [batch[c].to_pylist() for c in ("lo", "hi")]
    width = max((len(x) for x in lists[0]), default=0)
    return tuple(np.array([x + [fill] * (width - len(x)) for x in side], dtype=np.int64).reshape(len(side), width) for side, fill in zip(lists, (1, 0), strict=True))


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all inner products of their rows are exact in them: products of doubles are much faster."""
    most = lambda m: int(np.abs(m).max(initial=0))
    return (a.astype(np.float64), b.astype(np.float64)) if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53 else (a, b)


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 256, label=label)

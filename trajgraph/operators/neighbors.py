"""Neighbours and samples of polylines within subjects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajgraph.functions.polyline import AXES
from trajgraph.functions.ranks import largest_group, row_numbers
from trajgraph.functions.tables import kept


def recenter(df: DataFrame, keys: list[str], id_: str, points: str, centre: tuple[float, float, float]) -> DataFrame:
    """Moves each subject's lines so that the mean of every point position is the centre."""
    each = df.select(*keys, id_, F.posexplode(points).alias("pos", "p"))
    mean = each.groupBy(*keys, "pos").agg(*[F.avg(F.col("p")[c]).alias(f"_m{c}") for c in AXES])
    moved = each.join(mean, [*keys, "pos"])
    new = F.struct("pos", *[(F.col("p")[c] + (F.lit(x) - F.col(f"_m{c}"))).alias(c) for c, x in zip(AXES, centre, strict=True)])
    lists = moved.groupBy(*keys, id_).agg(F.array_sort(F.collect_list(new)).alias(points))
    return lists.withColumn(points, F.transform(points, lambda x: F.struct(*[x[c].alias(c) for c in AXES])))


#: Lines of a block: the distances of two blocks take some 70 MB.
BLOCK_LINES = 2048


def query_pairs(df: DataFrame, keys: list[str], id_: str, points: str, chosen: Column, blocks: int = 16) -> DataFrame:
    """(keys, x_id, y_id, x, y): the chosen lines as a query set against all other lines of the same keys, dealt to blocks."""
    block = F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("_block")
    x = df.where(chosen).select(*keys, F.col(id_).alias("x_id"), F.col(points).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    y = df.select(*keys, F.col(id_).alias("y_id"), F.col(points).alias("y"), block)
    return x.join(y, [*keys, "_block"]).where(F.col("x_id") != F.col("y_id")).drop("_block")


def nearest(x: np.ndarray, y: np.ndarray, turned: np.ndarray | None, ids: np.ndarray, k: int, n_points: int) -> tuple[np.ndarray, ...]:
    """Rows of x, neighbours (by ids of y), distances and flips of the k nearest rows of y to each row of x.

    Squared distances by norms and products find the candidates; those within their rounding error are measured exactly. Ties (to
    nine places) go to the smaller id.
    """
    norms = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    d = norms - 2 * (x @ y.T)
    if turned is not None:
        d = np.minimum(d, norms - 2 * (x @ turned.T))
    kth = np.partition(d, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
    # Nine places of a distance and the rounding of the products.
    slack = 1e-12 * norms.max(initial=1.0) + 4e-9 * n_points * np.sqrt(np.maximum(kth, 0.0)) + 1e-15
    row, col = np.nonzero(d <= (kth + slack)[:, None])
    dist = np.sqrt(((x[row] - y[col]) ** 2).sum(1)) / n_points
    flip = np.zeros(len(row), dtype=np.int32)
    if turned is not None:
        back = np.sqrt(((x[row] - turned[col]) ** 2).sum(1)) / n_points
        flip = (back < dist).astype(np.int32)
        dist = np.minimum(dist, back)
    order = np.lexsort((ids[col], np.round(dist, 9), row))
    row, col, dist, flip = row[order], col[order], dist[order], flip[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = place < k
    return row[top], ids[col[top]], dist[top], flip[top]


#: Pivots of an index, and the lines from which they are chosen.
PIVOTS, PIVOT_SAMPLE = 32, 1024


def between(x: np.ndarray, y: np.ndarray, flip: bool, n_points: int) -> np.ndarray:
    """Distances of every row of x to every row of y; with flip the smaller one of a line and its reverse."""
    norms = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    d = norms - 2 * (x @ y.T)
    if flip:
        d = np.minimum(d, norms - 2 * (x @ y.reshape(len(y), -1, 3)[:, ::-1].reshape(len(y), -1).T))
    return np.sqrt(np.maximum(d, 0.0)) / n_points


def pivots_of(lines: DataFrame, flip: bool, n_points: int) -> np.ndarray:
    """PIVOTS lines far from each other, the later ones nearer: each is the farthest from those before in a sample of PIVOT_SAMPLE
    lines with the smallest hashes. The first few of them are pivots of a coarser index."""
    rows = lines.orderBy(F.xxhash64("_id", "_v"), "_id").limit(PIVOT_SAMPLE).select("_v").collect()
    v = np.array([r[0] for r in rows], dtype=np.float64)
    d, chosen = between(v, v, flip, n_points), [0]
    while len(chosen) < min(PIVOTS, len(v)) and (gap := d[chosen].min(0)).max() > 0:
        chosen.append(int(gap.argmax()))
    return v[chosen]


def indexed(lines: DataFrame, on: list[str], flip: bool, n_points: int) -> DataFrame:
    """lines (on, _id, _v, ...) with _part, their block, and _d, their distances to all pivots; a stored table.

    A group with lines for b blocks uses the first b pivots: a line goes to its nearest one, and the lines of a pivot with more than
    BLOCK_LINES are parted by a hash. So blocks are compact, and few in small groups.
    """
    pivots = pivots_of(lines, flip, n_points)
    size = lines.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    counted = lines.join(size, on)
    names = [*lines.columns, "_cell", "_d"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = between(np.vstack(pdf["_v"]), pivots, flip, n_points)
            used = np.clip(-(-pdf["_n"].to_numpy() // BLOCK_LINES), 1, len(pivots))
            cell = np.where(np.arange(len(pivots)) < used[:, None], d, np.inf).argmin(1)
            yield pdf.drop(columns="_n").assign(_cell=cell, _d=list(d))[names]

    shape = T.StructType([*lines.schema, T.StructField("_cell", T.LongType()), T.StructField("_d", T.ArrayType(T.DoubleType()))])
    placed = kept(counted.select(*lines.columns, "_n").mapInPandas(measure, shape)) if lines.take(1) else kept(lines.withColumn("_cell", F.lit(0)).withColumn("_d", F.array(F.lit(0.0))))
    chunks = placed.groupBy(*on, "_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).alias("_chunks"))
    chunk = F.pmod(F.xxhash64("_id"), F.col("_chunks"))
    return kept(placed.join(chunks, [*on, "_cell"]).withColumn("_part", F.col("_cell") * (1 << 32) + chunk).drop("_cell", "_chunks"))


def near_blocks(lines: DataFrame, home: DataFrame, on: list[str], k: int) -> DataFrame:
    """(on, _part, _to): pairs of blocks that may hold neighbours for each other, a block with itself left out.

    home: the neighbours found in the own block; the k-th distance of the worst placed line of a block bounds what it still looks for.
    A pair is skipped when, for some pivot, the ranges of distances of both blocks lie farther apart than that: by the triangle
    inequality (which a line and its reverse taken as one keep) no line of the one is so near to one of the other.
    """
    n = len(lines.first()["_d"]) if lines.take(1) else 0
    bound = home.groupBy(*on, "_id").agg(F.count(F.lit(1)).alias("found"), F.max("dist").alias("far"))
    reach = F.max(F.when(F.col("found") >= k, F.col("far")).otherwise(float("inf"))).alias("reach")
    reaches = lines.where("_asks").join(bound, [*on, "_id"], "left").groupBy(*on, "_part").agg(reach)
    each = lambda f: F.array(*[f(F.element_at("_d", i + 1)) for i in range(n)])
    stats = lines.groupBy(*on, "_part").agg(each(F.min).alias("lo"), each(F.max).alias("hi"), F.max("_offers").alias("offers")).join(reaches, [*on, "_part"], "left")

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, part = np.vstack(pdf["lo"]), np.vstack(pdf["hi"]), pdf["_part"].to_numpy()
        reach = pdf["reach"].to_numpy(dtype=float)
        reach = np.where(np.isnan(reach), -1.0, reach + 1e-6 * (1.0 + np.where(np.isfinite(reach), reach, 0.0)))
        offers, out = pdf["offers"].to_numpy(dtype=bool), []
        for a in np.flatnonzero(reach >= 0):
            apart = np.maximum(lo - hi[a], lo[a] - hi).max(1)
            to = np.flatnonzero(offers & (apart <= reach[a]) & (np.arange(len(part)) != a))
            out.append(pd.DataFrame({c: np.full(len(to), key[i], dtype=object) for i, c in enumerate(on)} | {"_part": np.full(len(to), part[a]), "_to": part[to]}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*on, "_part", "_to"])

    shape = T.StructType([*[lines.schema[c] for c in on], T.StructField("_part", T.LongType()), T.StructField("_to", T.LongType())])
    return kept(stats.groupBy(*on).applyInPandas(pair, shape))  # a group has a row a block


def knn(df: DataFrame, keys: list[str], id_: str, points: str, k: int, candidates: DataFrame | None = None, block: int | None = None, endpoints: bool = False, flip: bool = True) -> DataFrame:
    """(keys, id, rank, neighbour, dist, flip): the k nearest lines of the same keys (and block), the line itself included.

    candidates: rows to choose from, by default all; block: search only among about so many lines of consecutive ids. Ties go to the
    smaller id. Groups of up to BLOCK_LINES lines are compared in a task each. Larger ones get an index of pivots (see indexed): lines
    look in their own block first, and then only in blocks that the triangle inequality doesn't rule out. The k nearest rows of a
    line leave a task, never its pairs, and nothing is left out that could be nearer.
    """
    on = list(keys)
    ends = F.array(F.element_at(points, 1), F.element_at(points, -1)) if endpoints else F.col(points)
    flat = F.flatten(F.transform(ends, lambda p: F.array(*[p[c].cast("double") for c in AXES]))).alias("_v")
    lines = df
    if block:
        n = df.groupBy(*keys).agg((F.greatest(F.floor(F.count(F.lit(1)) / block), F.lit(1))).alias("_blocks"), F.count(F.lit(1)).alias("_n"))
        placed = row_numbers(df, keys, [id_], "_rank").join(n, keys)
        lines = placed.withColumn("_block", F.floor(F.col("_rank") / (F.floor(F.col("_n") / F.col("_blocks")) + 1))).drop("_rank", "_blocks", "_n")
        on.append("_block")
    lines = lines.select(*on, F.col(id_).alias("_id"), flat, F.lit(True).alias("_asks"))
    if candidates is None:
        lines = lines.withColumn("_offers", F.lit(True))
    else:
        chosen = candidates.select(*keys, F.col(id_).alias("_id"), F.lit(True).alias("_offers")).distinct()
        lines = lines.join(chosen, [*keys, "_id"], "left").withColumn("_offers", F.coalesce("_offers", F.lit(False)))
    types = df.schema
    shape = T.StructType([*[lines.schema[c] for c in on], T.StructField("_id", types[id_].dataType), T.StructField("neighbour", types[id_].dataType), T.StructField("dist", T.DoubleType()), T.StructField("flip", T.IntegerType())])

    def work(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=shape.names)
        a, b = np.vstack(p["_v"]), np.vstack(q["_v"])
        out = []
        for x0 in range(0, len(a), BLOCK_LINES):
            for y0 in range(0, len(b), BLOCK_LINES):
                y, ids = b[y0 : y0 + BLOCK_LINES], q["_id"].to_numpy()[y0 : y0 + BLOCK_LINES]
                turned = y.reshape(len(y), -1, 3)[:, ::-1].reshape(len(y), -1) if flip else None
                row, near, dist, flips = nearest(a[x0 : x0 + BLOCK_LINES], y, turned, ids, k, 15)
                out.append(pd.DataFrame({c: np.full(len(row), key[i], dtype=object) for i, c in enumerate(on)} | {"_id": p["_id"].to_numpy()[x0:][row], "neighbour": near, "dist": dist, "flip": flips}))
        return pd.concat(out)

    def meet(x: DataFrame, y: DataFrame, dealt: list[str]) -> DataFrame:
        renamed = y.select(*[F.col(c).alias(c) for c in y.columns])  # named anew: it may be one table with x
        return x.groupBy(*dealt).cogroup(renamed.groupBy(*dealt)).applyInPandas(work, shape)

    lines = kept(lines)
    if largest_group(lines, on) <= BLOCK_LINES:
        found = meet(lines.where("_asks"), lines.where("_offers"), on)
    else:
        lines = indexed(lines, on, flip, 15)
        home = kept(meet(lines.where("_asks"), lines.where("_offers"), [*on, "_part"]))
        pairs = near_blocks(lines, home, on, k)
        asking = lines.where("_asks").drop("_d", "_offers").join(pairs, [*on, "_part"])
        offering = lines.where("_offers").select(*on, "_id", "_v", F.col("_part").alias("_to")).join(pairs, [*on, "_to"])
        found = home.unionByName(meet(asking, offering, [*on, "_part", "_to"]))
    # Equal to the last bits, lines may tie: distances are compared to nine places.
    near = Window.partitionBy(*keys, "_id").orderBy(F.round("dist", 9), "neighbour")
    top = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return top.select(*keys, F.col("_id").alias(id_), "neighbour", "dist", "flip", "rank")


def capped_sample(df: DataFrame, keys: list[str], order: Column, n: int, tie: str) -> DataFrame:
    """n rows of each subject without replacement, by the order of a hash."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).where(F.col("_k") <= n).drop("_k")


def rate_sample(df: DataFrame, keys: list[str], order: Column, rate: float, tie: str) -> DataFrame:
    """int(rows * rate) rows of each subject; all of them for a rate outside (0, 1)."""
    if not 0 < rate < 1:
        return df
    n = df.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * rate).alias("_n"))
    ranked = row_numbers(df.withColumn("_order", order), keys, ["_order", tie], "_k").join(n, keys)
    return ranked.where(F.col("_k") < F.col("_n")).drop("_k", "_n", "_order")


def global_sample(df: DataFrame, keys: list[str], id_: str, k: int, seed: int = 42, number: Column | None = None) -> DataFrame:
    """k rows of each subject with replacement, as (keys, draw, id, ...); draws depend on subject, draw and seed alone.

    number: a whole number of 0 or more from keys and `draw`, by default a hash.
    """
    ranked = row_numbers(df, keys, [id_], "_k")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = n.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    draws = draws.withColumn("_k", F.pmod(F.xxhash64(*keys, "draw", F.lit(seed)) if number is None else number, F.col("_n")))
    return draws.join(ranked, [*keys, "_k"]).drop("_k", "_n")


def augment(df: DataFrame, subject: str, points: str, params: DataFrame) -> DataFrame:
    """df once for each row (subject, aug_id, matrix) of params, its points under the matrix."""
    from trajgraph.functions.polyline import affine

    return df.join(params, subject).withColumn(points, affine(F.col(points), F.col("matrix"))).drop("matrix")


def augment_params(subjects: DataFrame, subject: str, n_aug: int, angle: float, scale: tuple[float, float], shift: float, seed: int = 42) -> DataFrame:
    """(subject, aug_id, matrix): one random rotation, scale and shift for each subject and repetition; (0, 0) scales by 1.

    Each is drawn from the MD5 of its name, subject, repetition and seed, so that other engines can draw alike.
    """
    from trajgraph.functions.polyline import affine_of

    def u(name: str, lo: float, hi: float) -> Column:
        digits = F.substring(F.md5(F.concat_ws("/", F.lit(name), F.col(subject).cast("string"), F.col("aug_id").cast("string"), F.lit(str(seed)))), 1, 12)
        return F.lit(lo) + F.lit(hi - lo) * (F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48)))

    s = u("scale", 1 - scale[0], 1 + scale[1]) if any(scale) else F.lit(1.0)
    rows = subjects.select(subject).distinct().withColumn("aug_id", F.explode(F.sequence(F.lit(0), F.lit(n_aug - 1))))
    return rows.select(subject, "aug_id", affine_of(*[u(c, -angle, angle) for c in "xyz"], s, *[u(f"t{c}", -shift, shift) for c in "xyz"]).alias("matrix"))


def include_original(augmented: DataFrame, original: DataFrame) -> DataFrame:
    return augmented.unionByName(original.withColumn("aug_id", F.lit(-1)))


def voxel(p: Column, size: float) -> Column:
    return F.struct(*[F.floor(p[c] / size).cast("long").alias(c) for c in AXES])


def sample_field(df: DataFrame, keys: list[str], points: str, field: DataFrame, size: float) -> DataFrame:
    """(keys, value): mean over a line's points of the field's value in their voxels; points in no voxel are left out."""
    each = df.select(*keys, F.explode(points).alias("p")).select(*keys, voxel(F.col("p"), size).alias("voxel"))
    return each.join(field.select("voxel", "value"), "voxel").groupBy(*keys).agg(F.avg("value").alias("value"))


def assign_endpoints(df: DataFrame, keys: list[str], points: str, parcellation: DataFrame, size: float) -> DataFrame:
    """(keys, node_a, node_b): nodes of the voxels of the first and the last point; 0 in no voxel."""
    e = df.select(*keys, voxel(F.element_at(points, 1), size).alias("va"), voxel(F.element_at(points, -1), size).alias("vb"))
    for v in "ab":
        e = e.join(parcellation.select(F.col("voxel").alias(f"v{v}"), F.col("node").alias(f"node_{v}")), f"v{v}", "left")
    return e.select(*keys, *[F.coalesce(f"node_{v}", F.lit(0)).alias(f"node_{v}") for v in "ab"])

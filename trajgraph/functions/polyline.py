"""Column helpers for polylines: arrays of structs (r, a, s)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("r", "a", "s")


def resample_floor(points: Column, m: int = 15) -> Column:
    """m points at even positions, each the point at the floor of its position."""
    last = F.size(points) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.element_at(points, F.floor(k * last / (m - 1)).cast("int") + 1))


def fractions(m: int, decay: float) -> list[float]:
    """Cumulative shares of a line's length at which m points stand; denser towards the ends as decay grows."""
    t = [-1 + 2 * i / (m - 2) for i in range(m - 1)] if m > 2 else [0.0] * (m - 1)
    w = [math.exp(-decay * abs(x)) for x in t]
    out, total = [0.0], 0.0
    for x in w:
        total += x / sum(w)
        out.append(total)
    return out


def resample(points: Column, m: int = 15, decay: float = 0.0) -> Column:
    """m points by linear interpolation at the fractions of (m, decay); the last position is held inside the line."""
    last = F.size(points) - 1

    def at(f: Column) -> Column:
        x = f * last
        lo = F.least(F.floor(x), last).cast("int")
        hi = F.least(F.ceil(x), last).cast("int")
        t = x - F.floor(x)
        p, q = F.element_at(points, lo + 1), F.element_at(points, hi + 1)
        return F.struct(*[(p[c] + t * (q[c] - p[c])).alias(c) for c in AXES])

    return F.transform(F.array(*[F.lit(f) for f in fractions(m, decay)]), at)


def hits_endpoint(points: Column, m: int, decay: float) -> Column:
    """Whether the last position rounds to the last point."""
    return F.round(F.lit(fractions(m, decay)[-1]) * (F.size(points) - 1)) == F.size(points) - 1


def _step(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in AXES[1:]), (p["r"] - q["r"]) * (p["r"] - q["r"])))


def length(points: Column) -> Column:
    """Sum of the segment lengths; 0 for fewer than two points."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), _step)
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def _squares(x: Column, y: Column) -> Column:
    each = F.zip_with(x, y, lambda p, q: sum(((p[c] - q[c]) * (p[c] - q[c]) for c in AXES[1:]), (p["r"] - q["r"]) * (p["r"] - q["r"])))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def distance(x: Column, y: Column, n_points: int = 15) -> Column:
    """Euclidean norm over all coordinates, divided by the number of points."""
    return F.sqrt(F.greatest(_squares(x, y), F.lit(0.0))) / n_points


def mdf(x: Column, y: Column, flip: bool = True, n_points: int = 15) -> Column:
    """struct(dist, flip): the smaller of the direct distance and that to the reversed line; flip 1 if the reversed one is nearer."""
    direct = distance(x, y, n_points)
    turned = distance(x, F.reverse(y), n_points)
    return F.struct(F.least(direct, turned).alias("dist"), (F.when(turned < direct, 1).otherwise(0) if flip else F.lit(0)).alias("flip"))


def ends(x: Column) -> Column:
    return F.array(F.element_at(x, 1), F.element_at(x, -1))


def mdf_endpoints(x: Column, y: Column, flip: bool = True, n_points: int = 15) -> Column:
    """mdf over first and last points alone, divided by the same number."""
    return mdf(ends(x), ends(y), flip, n_points)


def norm(x: Column) -> Column:
    """Sum of the squares of all coordinates."""
    return F.aggregate(F.transform(x, lambda p: sum((p[c] * p[c] for c in AXES[1:]), p["r"] * p["r"])), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: sum((p[c] * q[c] for c in AXES[1:]), p["r"] * q["r"])), F.lit(0.0), lambda a, v: a + v)


def distance_by_norms(nx: Column, ny: Column, xy: Column, n_points: int = 15) -> Column:
    """distance() from precomputed norms and the dot product."""
    return F.sqrt(F.greatest(nx + ny - 2 * xy, F.lit(0.0))) / n_points


def affine(points: Column, m: Column) -> Column:
    """points under a struct of a 3 x 4 matrix m00..m23."""
    row = lambda p, k: m[f"m{k}0"] * p["r"] + m[f"m{k}1"] * p["a"] + m[f"m{k}2"] * p["s"] + m[f"m{k}3"]
    return F.transform(points, lambda p: F.struct(*[row(p, k).alias(c) for k, c in enumerate(AXES)]))


def affine_of(rx: Column, ry: Column, rz: Column, scale: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """Rotations about r, a and s (radians, in this order), then scale, then shift, as one 3 x 4 matrix."""
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    rows = [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, tx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, ty], [-sy, cy * sx, cy * cx, tz]]
    return F.struct(*[(v if j == 3 else scale * v).alias(f"m{i}{j}") for i, r in enumerate(rows) for j, v in enumerate(r)])

"""Farthest and nearest points of large sets, in linear-logarithmic time.

Arrow functions for sets beyond what pairwise expressions are meant for; null for null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), counter-clockwise."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points: list) -> list:
        out: list = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def farthest(p: np.ndarray) -> float:
    """Largest distance of two points, by a pair of parallel lines turning around the hull."""
    h = hull(p)
    n = len(h)
    if n < 3:
        return 0.0 if n < 2 else float(np.sqrt(((h[0] - h[1]) ** 2).sum()))
    x, y, j, best = h[:, 0].tolist(), h[:, 1].tolist(), 1, 0.0

    def above(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    for i in range(n):
        k = (i + 1) % n
        while above(i, k, (j + 1) % n) > above(i, k, j):
            j = (j + 1) % n
        for a in (i, k):
            for b in (j, (j + 1) % n):
                best = max(best, (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2)
    return float(np.sqrt(best))


def nearest(p: np.ndarray) -> np.ndarray:
    """Distance of each point to its nearest other one. Points are put into a grid that
    gets twice as coarse each time; a point is done once a neighbour in the cells around
    it is no farther than a cell is wide, so those that are left never crowd a cell."""
    unique, of, counts = np.unique(p, axis=0, return_inverse=True, return_counts=True)
    near = np.where(counts > 1, 0.0, np.inf)
    low, side = unique.min(axis=0), float((unique.max(axis=0) - unique.min(axis=0)).max())
    width, left = side / 2**20 or 1.0, np.flatnonzero(counts == 1)
    while len(left) and len(unique) > 1:
        cell = np.floor((unique - low) / width).astype(np.int64)
        rows = int(cell[:, 1].max()) + 3
        key = cell[:, 0] * rows + cell[:, 1]
        order = np.argsort(key, kind="stable")
        keys = key[order]
        for dx in (-1, 0, 1):
            # three cells above one another follow each other
            a = np.searchsorted(keys, key[left] + dx * rows - 1)
            b = np.searchsorted(keys, key[left] + dx * rows + 1, side="right")
            size = b - a
            who = np.repeat(left, size)
            other = order[np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
            d = np.sqrt(((unique[who] - unique[other]) ** 2).sum(axis=1))
            np.minimum.at(near, who, np.where(who == other, np.inf, d))
        left = left[near[left] > width]
        width *= 2
    return near[of.ravel()]


def measured(f):
    """An Arrow function over arrays of points (struct x, y) with a number for each."""

    def run(points: pa.Array) -> pa.Array:
        out = []
        for one in points:
            if not one.is_valid:
                out.append(None)
                continue
            xy = one.values
            out.append(f(np.column_stack([xy.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])))
        return pa.array(out, pa.float64())

    run.__annotations__ = {"points": pa.Array, "return": pa.Array}
    return run


def farthest_distance(points: Column) -> Column:
    return F.arrow_udf(measured(farthest), "double")(points)


def nearest_mean(points: Column) -> Column:
    return F.arrow_udf(measured(lambda p: float(nearest(p).mean())), "double")(points)


MEASURES = "struct<extent:double,near:double,linear:double>"


def of_few(p: np.ndarray, least_linear: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets of the same number of points (sets, points, 2): largest distance, mean distance to
    the nearest other point, share of the larger principal variance. Sums go point by
    point, as the expressions in geometry do."""
    m, n = p.shape[:2]
    far, near = np.zeros(m), np.zeros(m)
    for i in range(n):
        d = np.sqrt(((p[:, i, None] - p) ** 2).sum(axis=2))
        far = np.maximum(far, d.max(axis=1))
        d[:, i] = np.inf
        near = near + d.min(axis=1)
    linear = np.full(m, np.nan)
    if n >= least_linear:
        total = lambda v: np.add.accumulate(v, axis=1)[:, -1]
        dx, dy = (p[:, :, k] - (total(p[:, :, k]) / n)[:, None] for k in (0, 1))
        xx, yy, xy = (total(v) / (n - 1) for v in (dx * dx, dy * dy, dx * dy))
        mid, half = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy)
        high, low = np.maximum(mid + half, 1e-9), np.maximum(mid - half, 1e-9)
        linear = high / (high + low)
    return far, near / n, linear


def measures(points: Column, most: int, least_linear: int) -> Column:
    """of_few() of sets of 2 to `most` points, as a struct; null for others."""

    def run(points: pa.Array) -> pa.Array:
        starts, flat = points.offsets.to_numpy(), points.values
        xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
        size = np.diff(starts)
        # a missing coordinate is left to the expressions
        bad = np.append(0, np.cumsum(np.isnan(xy).any(axis=1)))
        fit = points.is_valid().to_numpy(zero_copy_only=False) & (size >= 2) & (size <= most) & (bad[starts[1:]] == bad[starts[:-1]])
        out = np.full((3, len(size)), np.nan)
        for n in np.unique(size[fit]).tolist():
            at = np.flatnonzero(fit & (size == n))
            for k in range(0, len(at), max(1, 200_000 // n)):
                some = at[k : k + max(1, 200_000 // n)]
                out[:, some] = of_few(xy[starts[some][:, None] + np.arange(n)], least_linear)
        return pa.StructArray.from_arrays([pa.array(x, mask=np.isnan(x)) for x in out], ["extent", "near", "linear"], mask=pa.array(~fit))

    run.__annotations__ = {"points": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, MEASURES)(points)

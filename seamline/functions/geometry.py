"""Polygon geometry as array expressions (points: array of struct x, y).

Closed forms and higher-order functions; distances of all pairs only up to PAIRS points,
beyond that hull and grid (many_points).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions import many_points

PAIRS = 256
POINTS = "array<struct<x:double,y:double>>"


def from_flat(flat: Column) -> Column:
    """[x1, y1, x2, y2, ...] as points."""
    n = F.floor(F.size(flat) / 2).cast("int")
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, 2 * i).cast("double").alias("x"), F.get(flat, 2 * i + 1).cast("double").alias("y")))
    return F.when(n > 0, every).otherwise(F.array().cast(POINTS))


def to_flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def total(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))


def rounded(value: Column, digits: int) -> Column:
    """A number from 0 rounded by its product with a power of ten, as DuckDB rounds; F.round goes
    by the shortest decimal form, which differs where a sum lies next to a tie."""
    scaled = value * 10.0**digits
    return (F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)) / 10.0**digits


def area(points: Column) -> Column:
    """Shoelace area."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    twice = F.aggregate(F.arrays_zip(points.alias("a"), after.alias("b")), F.lit(0.0), lambda acc, z: acc + (z["a"]["x"] * z["b"]["y"] - z["b"]["x"] * z["a"]["y"]))
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(twice) / 2)


def equivalent_diameter(a: Column) -> Column:
    return F.when(a > 0, 2 * F.sqrt(a / math.pi)).otherwise(0.0)


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def major_diameter(points: Column) -> Column:
    """Largest distance of two vertices; 0 for fewer than two."""
    n = F.size(points)
    few = F.when(n <= PAIRS, points)
    far = F.array_max(F.transform(few, lambda p: F.array_max(F.transform(few, lambda q: distance(p, q)))))
    return F.when(n < 2, 0.0).when(n <= PAIRS, far).otherwise(many_points.farthest_distance(F.when(n > PAIRS, points)))


def nearest_mean(points: Column) -> Column:
    """Mean distance of each point to its nearest other one."""
    n = F.size(points)
    few = F.when(n <= PAIRS, points)
    near = F.transform(few, lambda p, i: F.array_min(F.filter(F.transform(few, lambda q, j: F.when(i != j, distance(p, q))), lambda d: d.isNotNull())))
    mean = F.aggregate(near, F.lit(0.0), lambda acc, d: acc + d) / F.nullif(n, F.lit(0))
    return F.when(n <= PAIRS, mean).otherwise(many_points.nearest_mean(F.when(n > PAIRS, points)))


def centroid(points: Column) -> Column:
    """Mean of the vertices (not the centre of area)."""
    n = F.size(points)
    return F.struct((total(points, lambda p: p["x"]) / n).alias("x"), (total(points, lambda p: p["y"]) / n).alias("y"))


def named(value: Column, f) -> Column:
    """f of a value that is computed once: an array of one element binds it, where
    an expression used several times (or in a lambda) would be computed as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spread(points: Column) -> Column:
    """Variances of the points (n - 1) along both axes, and covariance, as a struct."""
    n = F.size(points)

    def around(m: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy"))

        def add(acc: Column, p: Column) -> Column:
            dx, dy = p["x"] - m["x"], p["y"] - m["y"]
            return F.struct((acc["xx"] + dx * dx).alias("xx"), (acc["yy"] + dy * dy).alias("yy"), (acc["xy"] + dx * dy).alias("xy"))

        return F.aggregate(points, start, add, lambda acc: F.struct((acc["xx"] / (n - 1)).alias("xx"), (acc["yy"] / (n - 1)).alias("yy"), (acc["xy"] / (n - 1)).alias("xy")))

    return F.when(n >= 2, named(centroid(points), around))


def principal(points: Column) -> Column:
    """Struct of the principal variances high and low, not below 1e-9."""

    def eigen(s: Column) -> Column:
        mid, half = (s["xx"] + s["yy"]) / 2, F.sqrt(((s["xx"] - s["yy"]) / 2) * ((s["xx"] - s["yy"]) / 2) + s["xy"] * s["xy"])
        return F.struct(F.greatest(mid + half, F.lit(1e-9)).alias("high"), F.greatest(mid - half, F.lit(1e-9)).alias("low"))

    return named(spread(points), eigen)


def elongation(points: Column) -> Column:
    """Square root of the ratio of the principal variances; 1 for fewer than three points."""
    return F.when(F.size(points) < 3, 1.0).otherwise(named(principal(points), lambda v: F.sqrt(v["high"] / v["low"])))


def linearity(points: Column) -> Column:
    """Share of the larger principal variance."""
    return named(principal(points), lambda v: v["high"] / (v["high"] + v["low"]))


def shape(points: Column, limit: float = 1.8) -> Column:
    return F.when(elongation(points) >= limit, "길쭉한").otherwise("원형/구형")


def scaled(points: Column, w: Column, h: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * w).alias("x"), (p["y"] * h).alias("y")))


def normalised(points: Column, w: Column, h: Column, most: int = 1000, least_area: float = 1e-7) -> Column:
    """Points as shares of width and height (kept if they already are: none above 1.5),
    held in [0, 1], without repeated neighbours and closing point, thinned to at
    most `most`, rounded to 6; null if fewer than 3 or nearly without area."""
    already = F.coalesce(F.array_max(F.transform(points, lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"])))), F.lit(0.0)) <= 1.5
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    unit = F.transform(points, lambda p: F.struct(clamp(F.when(already, p["x"]).otherwise(p["x"] / w)).alias("x"), clamp(F.when(already, p["y"]).otherwise(p["y"] / h)).alias("y")))
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < 1e-9) & (F.abs(p["y"] - q["y"]) < 1e-9)
    empty = F.array().cast(POINTS)
    kept = F.aggregate(unit, empty, lambda acc, p: F.when((F.size(acc) > 0) & near(F.get(acc, F.size(acc) - 1), p), acc).otherwise(F.concat(acc, F.array(p))))

    def finish(k: Column) -> Column:
        closed = (F.size(k) > 1) & near(F.get(k, F.lit(0)), F.get(k, F.size(k) - 1))
        return F.when(closed, F.slice(k, 1, F.size(k) - 1)).otherwise(k)

    def thin(k: Column) -> Column:
        step = F.size(k) / F.lit(float(most))
        return F.when(F.size(k) > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(k, F.floor(i * step).cast("int")))).otherwise(k)

    def result(k: Column) -> Column:
        return F.when((F.size(k) >= 3) & (area(k) >= least_area), F.transform(k, lambda p: F.struct(F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))))

    # arrays of one element bind each step's result to a name
    bound = F.transform(F.transform(F.array(kept), finish), thin)
    return F.get(F.transform(bound, result), F.lit(0))


def circle(cx: Column, cy: Column, r: Column, n: int = 24) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((cx + r * F.cos(i * (2 * math.pi / n))).alias("x"), (cy + r * F.sin(i * (2 * math.pi / n))).alias("y")))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when((x2 > x1) & (y2 > y1), F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2)))


def box(values: Column) -> Column:
    """[x, y, w, h], or [x1, y1, x2, y2] if a side would not be positive."""
    v = [F.get(values, F.lit(i)).cast("double") for i in range(4)]
    return F.when(F.size(values) < 4, None).when((v[2] > 0) & (v[3] > 0), rectangle(v[0], v[1], v[0] + v[2], v[1] + v[3])).otherwise(rectangle(*v))


def label_line(points: Column, cls: int = 0) -> Column:
    """One line of a segmentation label file."""
    return F.concat_ws(" ", F.lit(str(cls)), F.array_join(F.transform(to_flat(points), lambda v: F.format_string("%.6f", v)), " "))

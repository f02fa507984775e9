"""Annotations anywhere in label files: a walk over JSON of unknown shape.

Every file is parsed once to VARIANT; then each level of nesting is one explode of the
containers that are still open, in the same stage: no shuffle, no Python, and rows only
for containers on the way to a geometry. The number of levels is measured first. Objects'
keys come in alphabetical order. Files that do not parse have one row of outcome `error`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.functions import json_geometry as J

#: What became of a node, in the order of the tests.
OUTCOMES = ("matched", "skipped_label", "skipped_geom", "skipped_invalid")
STEP = "array<struct<path:string,node:variant,open:boolean>>"


def brackets(text: Column) -> Column:
    """The brackets outside of strings, all as []; where one closes just before another opens
    both are left out, which leaves the depth as it is."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    return F.regexp_replace(F.regexp_replace(F.translate(bare, "{}", "[]"), r"[^\[\]]+", ""), r"(\]\[)+", "")


def nesting(brackets: Column) -> Column:
    """Depth of brackets."""
    turns = F.split(brackets, "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(turns, start, step, lambda acc: acc["most"])


def nodes(files: DataFrame, text: str = "text", levels: int | None = None) -> DataFrame:
    """files without text, with path and e (its entries), a row for each object that holds a
    geometry, and a row with null path for each file that does not parse.

    levels: the deepest nesting, if it is known."""
    rest = [c for c in files.columns if c != text]
    clean = F.regexp_replace(F.col(text), "^﻿", "")
    depth = levels if levels is not None else files.select(brackets(F.col(text)).alias("_b")).distinct().agg(F.max(nesting(F.col("_b")))).first()[0] or 0
    rows = files.select(*rest, F.try_parse_json(clean).alias("node")).withColumns({"path": F.when(F.col("node").isNotNull(), "$"), "open": F.col("node").isNotNull()})

    def children(node: Column, path: Column) -> Column:
        one = lambda at, v: F.struct(F.concat(path, at).alias("path"), v.alias("node"), F.lit(True).alias("open"))
        of_object = F.transform(F.map_entries(J.as_type(node, "map<string,variant>")), lambda e: one(F.concat(F.lit("."), e["key"]), e["value"]))
        of_array = F.transform(J.as_type(node, "array<variant>"), lambda v, i: one(F.concat(F.lit("["), i.cast("string"), F.lit("]")), v))
        return F.filter(F.coalesce(of_object, of_array, F.array().cast(STEP)), lambda x: J.is_kind(x["node"], "^(OBJECT|ARRAY)"))

    for _ in range(max(0, depth)):
        done = F.struct("path", "node", F.lit(False).alias("open"))
        stays = ~F.col("open") | J.has_geometry(J.entries(F.col("node")))
        step = F.concat(F.when(stays, F.array(done)).otherwise(F.array().cast(STEP)), F.when(F.col("open"), children(F.col("node"), F.col("path"))).otherwise(F.array().cast(STEP)))
        rows = rows.select(*rest, F.explode(step).alias("_x")).select(*rest, "_x.*")
    return rows.where("not open").select(*rest, "path", F.when(F.col("path").isNotNull(), J.entries(F.col("node"))).alias("e"))


def extracted(files: DataFrame, w: str = "w", h: str = "h", text: str = "text", default: bool = True, levels: int | None = None, most: int = 1000, least_area: float = 1e-7) -> DataFrame:
    """nodes with label, outcome and points (of matched ones, as shares of w and h). default:
    nodes without a label count as porosity."""
    rows = nodes(files, text, levels)
    rest = [c for c in rows.columns if c != "e"]
    e, no_points = F.col("e"), F.lit(None).cast(G.POINTS)

    def judged(label: Column) -> Column:
        wanted = F.coalesce(label.isin(*J.POROSITY), F.lit(default)) & ~F.coalesce(label.isin(*J.NORMAL), F.lit(False))
        return G.named(F.when(wanted, J.polygon(e)), lambda drawn: G.named(F.when((F.col(w) > 0) & (F.col(h) > 0) & drawn.isNotNull(), G.normalised(drawn, F.col(w), F.col(h), most, least_area)), lambda points: told(label, wanted, drawn, points)))

    def told(label: Column, wanted: Column, drawn: Column, points: Column) -> Column:
        outcome = F.when(F.col("path").isNull(), "error").when(~wanted, "skipped_label").when(drawn.isNull(), "skipped_geom").when(points.isNull(), "skipped_invalid").otherwise("matched")
        return F.struct(label.alias("label"), outcome.alias("outcome"), F.coalesce(points, no_points).alias("points"))

    # through an explode, so that no later filter or projection computes the polygon again
    return rows.select(*rest, F.explode(F.array(G.named(J.label(e), judged))).alias("_x")).select(*rest, "_x.*")


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """Nodes by outcome, and files that do not parse."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return rows.groupBy(*by).agg(F.count_if(F.col("outcome") != "error").alias("nodes"), *counts, F.count_if(F.col("outcome") == "error").alias("errors"))

"""Image catalogue and dataset selection: reports, quotas, subsets, verification."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators import annotations
from seamline.operators.order import chosen, numbered
from seamline.sources.tables import kept

# The size of a tile image.
TILE_W, TILE_H = 1280, 720


def with_shape(catalogue: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    """is_tile (exactly a tile), croppable (a tile fits) and aspect."""
    x, y = F.col(w), F.col(h)
    return catalogue.withColumns({"is_tile": (x == TILE_W) & (y == TILE_H), "croppable": (x >= TILE_W) & (y >= TILE_H), "aspect": F.try_divide(x.cast("double"), y)})


def positives(catalogue: DataFrame, split: str, case: str = "porosity") -> DataFrame:
    return catalogue.where((F.col("annotation_case") == case) & (F.col("split") == split) & F.col("image_exists") & F.col("is_tile"))


def leakage(catalogue: DataFrame, by: str = "class") -> DataFrame:
    """Per class the count, tiles and mean shape, which must not give the class away."""
    n = F.count(F.lit(1))
    return catalogue.groupBy(by).agg(n.alias("n"), F.count_if("is_tile").alias("tiles"), *(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("width", "height", "aspect")), F.round(F.count_if("is_tile") / n, 3).alias("tile_ratio"))


def by_class_and_split(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("class", "split").agg(F.count(F.lit(1)).alias("n"))


def hash_order(key: Column, seed: int) -> Column:
    """An order that looks random, is the same everywhere, and needs no generator."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def capped(rows: DataFrame, most: int, key: str, seed: int = 42) -> DataFrame:
    """At most `most` rows, chosen by hash order."""
    return chosen(rows, most, hash_order(F.col(key), seed), F.col(key))


def negative_base(catalogue: DataFrame, split: str) -> DataFrame:
    return catalogue.where((F.col("annotation_case") == "normal") & (F.col("split") == split) & F.col("image_exists"))


def case_rows(catalogue: DataFrame) -> DataFrame:
    """Images for the case table with their verdict: porosity of single objects (tiles or
    not) is abnormal, tiles without defects are normal."""
    abnormal = (F.col("annotation_case") == "porosity") & (F.col("is_crowd") == 0)
    normal = (F.col("annotation_case") == "normal") & F.col("is_tile")
    return catalogue.where("image_exists").withColumn("verdict", F.when(abnormal, "abnormal").when(normal, "normal")).where("verdict is not null")


def negatives(rows: DataFrame, wanted: int, key: str = "label_id", seed: int = 42, crops: int = 2) -> DataFrame:
    """Negatives: all tiles up to the number wanted, then crops of panoramas: as many
    panoramas as give the rest with `crops` each (or all there are), each with its share
    of crops, the first ones with one more."""
    tiles = kept(capped(rows.where("is_tile"), wanted, key, seed).withColumn("crops", F.lit(0)), "negative-tiles")
    rest = max(0, wanted - tiles.count())
    pool = rows.where("not is_tile and croppable")
    n = min(pool.count(), -(-rest // crops))
    if not n:
        return tiles
    placed = numbered(pool, hash_order(F.col(key), seed), F.col(key)).where(F.col("place") <= n)
    share = F.lit(rest // n) + F.when(F.col("place") <= rest % n, 1).otherwise(0)
    return tiles.unionByName(placed.withColumn("crops", share.cast("int")).drop("place"))


def crop_origins(rows: DataFrame, key: str = "label_id", seed: int = 42, tile: tuple[int, int] = (TILE_W, TILE_H)) -> DataFrame:
    """rows (width, height, crops) with k, x0 and y0, a row for each crop: the origin comes from
    Python's own generator, seeded with the first 16 hex digits of md5(seed:key:k), so
    it is the same on every run and everywhere. No rows where the tile doesn't fit."""

    def origin(label, k: int, w: int, h: int) -> tuple[int, int]:
        draw = random.Random(int(hashlib.md5(f"{seed}:{label}:{k}".encode()).hexdigest()[:16], 16)).randint
        return draw(0, w - tile[0]), draw(0, h - tile[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [origin(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("_key", "k", "width", "height")))]
            xy = [pa.array([p[i] for p in at], pa.int32()) for i in (0, 1)]
            names = [c for c in batch.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *xy], [*names, "x0", "y0"])

    fits = rows.where((F.col("width") >= tile[0]) & (F.col("height") >= tile[1]) & (F.col("crops") > 0))
    each = fits.withColumns({"k": F.explode(F.sequence(F.lit(0), F.col("crops") - 1)), "_key": F.col(key)})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema if f.name != "_key")
    return each.mapInArrow(run, f"{kinds}, x0 int, y0 int")


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def selected(catalogue: DataFrame, split: str, most: int | None = None, seed: int = 42) -> DataFrame:
    pos = positives(catalogue, split)
    return kept(pos if most is None else capped(pos, most, "label_id", seed), "positives")


def label_lines(pos: DataFrame, files: DataFrame) -> DataFrame:
    """label_id, missing (no label file), n_poly and label_text of selected positives, as a table."""
    texts = kept(pos.select("label_id", "width", "height").join(files.select("label_id", "text"), "label_id", "left"), "label-texts")
    found = annotations.extracted(texts.where("text is not null"), "width", "height").where("outcome = 'matched'")
    lines = found.groupBy("label_id").agg(F.count(F.lit(1)).alias("n_poly"), F.sort_array(F.collect_list(F.struct("path", G.label_line(F.col("points")).alias("line")))).alias("of"))
    text = F.concat(F.array_join(F.transform("of", lambda x: x["line"]), "\n"), F.lit("\n"))
    rows = texts.select("label_id", F.col("text").isNull().alias("missing")).join(lines, "label_id", "left")
    return kept(rows.select("label_id", "missing", F.coalesce("n_poly", F.lit(0)).cast("int").alias("n_poly"), F.coalesce(text, F.lit("")).alias("label_text")), "label-lines")


def build_split(catalogue: DataFrame, files: DataFrame, split: str, ratio: float = 1.0, most: int | None = None, crops: int = 2, seed: int = 42, pos: DataFrame | None = None, lines: DataFrame | None = None) -> tuple[DataFrame, Observation]:
    """One split of a training set, a row for each image or crop: status, stem, label, source,
    label_id, n_poly, label_text (lines of its label file, empty for background); and
    an Observation with the counters, filled by the action that writes the rows.

    catalogue: with_shape()d; files: label_id, text (label JSON). Positives without a label
    file or without a polygon in it are kept as such, but are no part of the set; there are
    `ratio` times the selected positives as negatives, rounded to even. pos, lines: what
    selected() and label_lines() gave, if that is done already."""
    pos = selected(catalogue, split, most, seed) if pos is None else pos
    lines = label_lines(pos, files) if lines is None else lines
    columns = ("status", "stem", "label", "source", "label_id", "n_poly", "label_text")
    none = {"n_poly": F.lit(0), "label_text": F.lit(""), "label": F.lit(0)}
    status = F.when(F.col("missing"), "pos_missing").when(F.col("n_poly") == 0, "pos_no_poly").otherwise("pos_ok")
    rows = pos.select("label_id", "filename").join(lines, "label_id").withColumns({"status": status, "stem": stem(F.col("filename")), "label": F.lit(1), "source": F.lit("tile")}).select(*columns)
    others = negatives(negative_base(catalogue, split), round(pos.count() * ratio), "label_id", seed, crops)
    tiles = others.where("crops = 0").withColumns(none | {"status": F.lit("neg_tile"), "stem": stem(F.col("filename")), "source": F.lit("tile")})
    cut = crop_origins(others.select("label_id", "filename", "width", "height", "crops"), seed=seed)
    cut = cut.withColumns(none | {"status": F.lit("neg_crop"), "stem": F.concat_ws("_", stem(F.col("filename")), F.concat(F.lit("crop"), "k"), "x0", "y0"), "source": F.lit("crop")})
    rows = rows.unionByName(tiles.select(*columns)).unionByName(cut.select(*columns)).withColumn("split", F.lit(split))
    seen = Observation(f"split {split}")
    return rows.observe(seen, *(v.alias(k) for k, v in split_counters().items())), seen


STATUSES = ("pos_ok", "pos_no_poly", "pos_missing", "neg_tile", "neg_crop")
IN_SET = "status in ('pos_ok', 'neg_tile', 'neg_crop')"


def split_counters() -> dict[str, Column]:
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    return counts | {"total_polygons": F.coalesce(F.sum("n_poly"), F.lit(0)), "n_images": F.count_if(F.expr(IN_SET))}


def build_all(catalogue: DataFrame, files: DataFrame, splits=("train", "val"), most: int | None = None, seed: int = 42, **settings) -> tuple[DataFrame, DataFrame]:
    """(manifest, counters) of all splits: label files are read once for all, each split's rows
    are written once, and the counters come from that same pass."""
    pos = {s: selected(catalogue, s, most, seed) for s in splits}
    lines = label_lines(reduce(DataFrame.unionByName, pos.values()), files)
    rows, counted = [], []
    for s in splits:
        built, seen = build_split(catalogue, files, s, most=most, seed=seed, pos=pos[s], lines=lines, **settings)
        rows.append(kept(built, f"split-{s}"))
        counted.append((s, *(seen.get[k] for k in split_counters())))
    table = catalogue.sparkSession.createDataFrame(counted, ", ".join(["split string", *(f"{k} bigint" for k in split_counters())]))
    return reduce(DataFrame.unionByName, rows).where(IN_SET).drop("status"), table


def balanced(rows: DataFrame, wanted: int, groups=("split", "label"), key: str = "stem", seed: int = 42) -> DataFrame:
    """At most `wanted` rows of each group, by hash order; Spark limits each task to
    that before the shuffle."""
    place = F.row_number().over(W.partitionBy(*groups).orderBy(hash_order(F.col(key), seed), key))
    return rows.withColumn("place", place).where(F.col("place") <= wanted)


def unmatched(images: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = images.select(on).distinct(), labels.select(on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("no label")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("no image")))


def line_faults(line: Column) -> Column:
    """What is wrong with one line of a segmentation label file, null if nothing:
    class and at least three pairs of numbers, all within [0, 1]."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    values = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) < 7) | (F.size(parts) % 2 == 0) | F.exists(values, lambda v: v.isNull()), "grammar").when(F.exists(values, lambda v: (v < 0) | (v > 1)), "range")


def verified(files: DataFrame) -> DataFrame:
    """Counts over label files (stem, text): empty, with bad lines, out of range."""
    faults = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), line_faults)
    rows = files.select(F.size(faults).alias("n"), F.exists(faults, lambda f: f == "grammar").alias("bad"), F.exists(faults, lambda f: f == "range").alias("out"))
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if("bad").alias("bad_lines"), F.count_if("out").alias("out_of_range"))


def verdict_codes(label: Column, normal=("normal", "ok", "정상"), default: str = "porosity") -> Column:
    """Normalised label: trimmed, lower case, no spaces, minus as underline; normal
    aliases give null, a missing label the default."""
    n = F.translate(F.lower(F.trim(label)), "- ", "_")
    return F.when(label.isNull(), default).when(n.isin(*normal), None).otherwise(n)


#: What may exceed [0, 1] by rounding.
SLACK = 1e-6


def text_faults(text: Column) -> Column:
    """(lines, bad_lines, bad_coords) of a label file. A bad line has fewer than three pairs,
    half a pair or no number; a good one with values outside [0, 1] has bad coordinates."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    parts = lambda line: F.filter(F.split(line, r"\s+"), lambda x: x != "")
    rows = F.transform(lines, lambda line: F.transform(F.slice(parts(line), 2, F.greatest(F.size(parts(line)) - 1, F.lit(0))), lambda x: x.try_cast("double")))
    bad = lambda v: (F.size(v) < 6) | (F.size(v) % 2 != 0) | F.exists(v, lambda x: x.isNull())
    out = lambda v: ~bad(v) & F.exists(v, lambda x: (x < -SLACK) | (x > 1 + SLACK))
    return F.struct(F.size(rows).alias("lines"), F.size(F.filter(rows, bad)).alias("bad_lines"), F.size(F.filter(rows, out)).alias("bad_coords"))


def split_report(images: DataFrame, labels: DataFrame, tile: tuple[int, int] = (TILE_W, TILE_H)) -> DataFrame:
    """One row per split of images (split, stem, width, height) and label files (split, stem,
    text): counts, those without a partner, empty files, faults of lines, images of a
    wrong or unknown size. Every image is held against the size. A label file without
    text counts as empty; repeated stems of a split count once, and with the worst size.
    """
    fits = F.col("width").eqNullSafe(tile[0]) & F.col("height").eqNullSafe(tile[1])
    a = images.groupBy("split", "stem").agg(F.every(fits).alias("fits"))
    b = labels.groupBy("split", "stem").agg(text_faults(F.coalesce(F.max("text"), F.lit(""))).alias("f"))
    met = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["split", "stem"], "full")
    count = lambda c, name: F.count_if(c).alias(name)
    image, label = F.col("a").isNotNull(), F.col("b").isNotNull()
    return met.groupBy("split").agg(
        count(image, "n_images"), count(label, "n_labels"), count(image & ~label, "image_without_label"), count(label & ~image, "label_without_image"), count(label & (F.col("f.lines") == 0), "empty_labels"),
        F.coalesce(F.sum("f.bad_lines"), F.lit(0)).alias("bad_lines"), F.coalesce(F.sum("f.bad_coords"), F.lit(0)).alias("bad_coords"), count(image & ~F.col("fits"), "wrong_size"), count(image, "size_checked"),
    )


def label_places(found: DataFrame, catalogue: DataFrame, key: str = "label_id") -> DataFrame:
    """found with label_path, width and height of its label in the catalogue, null where it is not listed."""
    return found.join(catalogue.select(key, "label_path", "width", "height"), key, "left")

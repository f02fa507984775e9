"""Polygons and labels out of JSON objects of unknown shape, as expressions over VARIANT.

A node is an object's entries: array of struct(key in lower case, value). Of equal keys the
last counts. Coordinates may be numbers or strings of numbers; where one cannot be read the
whole geometry is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions import geometry as G

# Names of keys, in order of preference.
POLYGON_KEYS = ("segmentation", "polygon", "polygons", "points", "coordinates", "coordinate", "coords", "poly", "seg", "contour", "vertices")
BOX_KEYS = ("bbox", "box", "bndbox", "rect", "rectangle", "boundingbox", "bounding_box")
LABEL_KEYS = ("case", "defect_type", "defect", "annotation_case", "category_name", "class_name", "label", "category", "name", "tag", "title", "class", "type")
CENTRE_KEYS = ("center", "centre")
RADIUS_KEYS = ("r", "radius", "rad")
NAME_KEYS = ("name", "label", "class", "kor", "eng")
X_KEYS, Y_KEYS = ("x", "cx", "col"), ("y", "cy", "row")
BOX_CORNERS = (("xmin", "ymin", "xmax", "ymax"), ("left", "top", "right", "bottom"))
# Spellings of the labels.
POROSITY = ("기공", "porosity", "pore", "blowhole", "gas_pore", "gasporosity", "porosities", "기공결함")
NORMAL = ("정상", "normal", "ok", "sound", "no_defect", "nodefect")

NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"


def as_type(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def is_kind(v: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(pattern), F.lit(False))


def entries(node: Column) -> Column:
    """A node's entries; null where it is no object."""
    return F.transform(F.map_entries(as_type(node, "map<string,variant>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))


def has(e: Column, *keys: str) -> Column:
    return F.exists(e, lambda x: x["key"].isin(*keys))


def lookup(e: Column, key) -> Column:
    found = F.filter(e, lambda x: x["key"] == key)
    return F.get(found, F.size(found) - 1)["value"]


def number(e: Column, key: str) -> Column:
    return as_type(lookup(e, key), "double")


def first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def of_keys(e: Column, keys: tuple[str, ...], f) -> Column:
    """f of the values of these keys, in their order; the first that is not null. Only keys that
    are there cost anything."""
    there = F.filter(F.lit(list(keys)), lambda k: F.exists(e, lambda x: x["key"] == k))
    return first(F.transform(there, lambda k: G.named(lookup(e, k), f)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def whole(points: Column, least: int = 3) -> Column:
    """Points if there are enough and every one has both coordinates."""
    good = lambda points: F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return G.named(points, lambda points: F.when((F.size(points) >= least) & good(points), points))


def pairs(v: Column) -> Column:
    """Points out of one of the layouts: {"x": [...], "y": [...]}, a list of pairs, a list of
    objects, a flat list, or a list of flat lists, of which the first counts."""

    def axis(m: Column, names: tuple[str, ...]) -> Column:
        return as_type(F.get(F.filter(F.map_entries(m), lambda x: F.lower(x["key"]).isin(*names)), F.lit(0))["value"], "double")

    def parallel(e: Column) -> Column:
        x, y = as_type(lookup(e, "x"), "array<double>"), as_type(lookup(e, "y"), "array<double>")
        return F.when(F.size(x) == F.size(y), whole(F.zip_with(x, y, point)))

    def listed(ring: Column) -> Column:
        start = as_type(ring, "variant", "$[0]")
        flat = as_type(ring, "array<double>")
        of_lists = F.transform(as_type(ring, "array<array<double>>"), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
        of_objects = F.transform(as_type(ring, "array<map<string,variant>>"), lambda m: point(axis(m, X_KEYS), axis(m, Y_KEYS)))
        of_numbers = G.named(flat, lambda flat: F.when((F.size(flat) >= 6) & (F.size(flat) % 2 == 0), G.from_flat(flat)))
        return whole(F.when(is_kind(start, "^ARRAY"), of_lists).when(is_kind(start, "^OBJECT"), of_objects).when(is_kind(start, NUMBER), of_numbers))

    inner = as_type(v, "array<variant>", "$[0]")
    nested = (F.size(inner) >= 6) & F.forall(inner, lambda x: is_kind(x, NUMBER))
    ring = F.when(F.coalesce(nested, F.lit(False)), as_type(v, "variant", "$[0]")).otherwise(v)
    return F.when(is_kind(v, "^OBJECT"), G.named(entries(v), parallel)).otherwise(G.named(ring, listed))


def corners(v: Column) -> Column:
    """The two points of a list of two, as struct x1, y1, x2, y2."""
    p = F.transform(as_type(v, "array<array<double>>"), lambda q: point(F.get(q, F.lit(0)), F.get(q, F.lit(1))))
    return G.named(p, lambda p: F.when(F.size(whole(p, 2)) == 2, F.struct(p[0]["x"].alias("x1"), p[0]["y"].alias("y1"), p[1]["x"].alias("x2"), p[1]["y"].alias("y2"))))


def between(v: Column) -> Column:
    """The upright rectangle with two opposite corners; null without area."""
    return G.named(corners(v), lambda c: G.rectangle(F.least(c["x1"], c["x2"]), F.least(c["y1"], c["y2"]), F.greatest(c["x1"], c["x2"]), F.greatest(c["y1"], c["y2"])))


def drawn(e: Column, keys, f) -> Column:
    """f of the numbers of these keys, each read once."""
    return G.named(F.struct(*(number(e, k).alias(k) for k in keys)), f)


def box(v: Column) -> Column:
    """A box as a list of four, or an object of corners or of corner, width and height."""

    def named(e: Column) -> Column:
        sides = drawn(e, "xywh", lambda s: G.rectangle(s["x"], s["y"], s["x"] + s["w"], s["y"] + s["h"]))
        all_of = lambda names: F.forall(F.lit(list(names)), lambda k: F.exists(e, lambda x: x["key"] == k))
        first_form, other_form = BOX_CORNERS
        by_corners = lambda form: drawn(e, form, lambda s: G.rectangle(*(s[k] for k in form)))
        return F.when(all_of(first_form), by_corners(first_form)).when(all_of("xywh"), sides).when(all_of(other_form), by_corners(other_form))

    four = G.named(as_type(v, "array<double>"), lambda four: F.when(F.size(four) == 4, G.box(four)))
    return F.when(is_kind(v, "^OBJECT"), G.named(entries(v), named)).otherwise(four)


def circle(e: Column, n: int = 24) -> Column:
    """A circle as a polygon: centre as a list or cx and cy, and the first radius key there is."""
    centre = of_keys(e, CENTRE_KEYS, lambda v: F.when(F.size(as_type(v, "array<double>")) >= 2, as_type(v, "array<double>")))
    at = F.coalesce(centre, F.when(has(e, "cx") & has(e, "cy"), F.array(number(e, "cx"), number(e, "cy"))))
    radius = F.coalesce(*(F.when(has(e, k), F.array(number(e, k))) for k in RADIUS_KEYS))[0]
    # a circle's numbers are read once, not at each of its points
    numbers = G.named(at, lambda at: F.struct(at[0].alias("x"), at[1].alias("y"), radius.alias("r")))
    return G.named(numbers, lambda c: F.when(c["r"] > 0, whole(G.circle(c["x"], c["y"], c["r"], n))))


def label(e: Column) -> Column:
    """The node's label: of the keys in order, the first with a text, a whole number, or an
    object with a name; null without any."""

    def text(v: Column) -> Column:
        name = F.get(F.filter(entries(v), lambda x: x["key"].isin(*NAME_KEYS)), F.lit(0))["value"]
        return F.when(is_kind(v, "^(STRING|BIGINT|BOOLEAN)"), as_type(v, "string")).when(is_kind(v, "^OBJECT"), as_type(name, "string"))

    return normal_form(of_keys(e, LABEL_KEYS, text))


def normal_form(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "- ", "_")


def has_geometry(e: Column) -> Column:
    def found(e: Column) -> Column:
        radius = has(e, *RADIUS_KEYS)
        return has(e, *POLYGON_KEYS, *BOX_KEYS) | (has(e, "cx") & has(e, "cy") & radius) | (has(e, *CENTRE_KEYS) & radius)

    return F.coalesce(G.named(e, found), F.lit(False))


def polygon(e: Column) -> Column:
    """A node's polygon: a circle or rectangle that says so, else a polygon key, a circle, a box."""
    kind, drawn = normal_form(as_type(lookup(e, "shape_type"), "string")), lookup(e, "points")

    def around(v: Column) -> Column:
        def numbers(p: Column) -> Column:
            c, edge = F.get(p, F.lit(0)), F.get(p, F.lit(1))
            radius = F.sqrt(F.pow(F.get(edge, F.lit(0)) - F.get(c, F.lit(0)), 2) + F.pow(F.get(edge, F.lit(1)) - F.get(c, F.lit(1)), 2))
            return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"), radius.alias("r"))

        return G.named(G.named(as_type(v, "array<array<double>>"), numbers), lambda c: F.when(c["r"] > 0, G.circle(c["x"], c["y"], c["r"])))

    def straight(v: Column) -> Column:
        four = lambda c: F.array(point(c["x1"], c["y1"]), point(c["x2"], c["y1"]), point(c["x2"], c["y2"]), point(c["x1"], c["y2"]))
        return F.coalesce(pairs(v), G.named(corners(v), lambda c: F.when(c.isNotNull(), four(c))))

    return F.coalesce(
        F.when(kind == "circle", G.named(drawn, around)),
        F.when(kind == "rectangle", G.named(drawn, straight)),
        of_keys(e, POLYGON_KEYS, lambda v: F.coalesce(pairs(v), between(v))),
        circle(e),
        of_keys(e, BOX_KEYS, box),
    )

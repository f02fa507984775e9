"""Numbers, running sums and quantiles over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.sources.tables import kept


def part_of(at: str = "_at") -> Column:
    return F.shiftright(at, 33)


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """rows dealt into ranges of the order and sorted, as a table, with _at: the range's
    number (upper bits) and the place in it."""
    return kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def offsets(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """_part and, per sum, its total over all ranges before; a row a range goes through the driver."""
    before, out = [0] * len(sums), []
    for r in parts.groupBy(part_of().alias("_part")).agg(*(c.alias(k) for k, c in sums.items())).orderBy("_part").collect():
        out.append((r["_part"], *before))
        before = [a + (r[k] or 0) for a, k in zip(before, sums)]
    kinds = dict(parts.select(*(c.alias(k) for k, c in sums.items())).dtypes)
    return parts.sparkSession.createDataFrame(out, ", ".join(["_part bigint", *(f"{k} {kinds[k]}" for k in sums)]))


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their number in the order, from 1. The order should have no ties; equal
    rows are numbered in any order."""
    parts = in_ranges(rows, *order)
    first = offsets(parts, {"_before": F.count(F.lit(1))})
    return parts.join(F.broadcast(first), part_of() == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def running(rows: DataFrame, *order: Column, **sums: str) -> DataFrame:
    """rows with running sums (name=column) in the order, own row included."""
    parts = in_ranges(rows, *order)
    first = offsets(parts, {f"_{k}": F.sum(c) for k, c in sums.items()}).withColumnRenamed("_part", "_range")
    upto = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    own = parts.withColumn("_part", part_of()).withColumns({k: F.sum(c).over(upto) for k, c in sums.items()})
    out = own.join(F.broadcast(first), F.col("_part") == F.col("_range")).withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums})
    return out.drop("_at", "_part", "_range", *(f"_{k}" for k in sums))


def chosen(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` rows in the order."""
    return numbered(rows, *order, name="_place").where(F.col("_place") <= most).drop("_place")


def quantiles(rows: DataFrame, value: str, shares: list[float], bins: int = 1024) -> list[float | None]:
    """Exact quantiles with linear interpolation; None without values (nulls and NaN are none).

    Selection by range counts: each pass counts values in `bins` parts of the ranges that
    still hold a wanted one, and goes on with the part it is in, until this part is one
    value. A row a part is shuffled by each task; about six passes at most."""
    v = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    at = [share * (n - 1) for share in shares]
    found: dict[int, float] = {}
    # wanted place: (place within the range, least and largest value of the range)
    open_ = {k: (k, low, high) for p in at for k in (int(p), min(int(p) + 1, n - 1))}
    while open_:
        for k in [k for k, (_, lo, hi) in open_.items() if lo == hi]:
            found[k] = open_.pop(k)[1]
        ranges = sorted({(lo, hi) for _, lo, hi in open_.values()})
        if not ranges:
            break

        def part(i: int) -> Column:
            lo, hi = ranges[i]
            place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)) if hi - lo < float("inf") else F.when(F.col("v") < lo / 2 + hi / 2, 0).otherwise(bins - 1)
            # the largest value stands alone, so every pass splits the range
            return F.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("i"), F.when(F.col("v") == hi, bins).otherwise(place).cast("int").alias("b")))

        seen = v.select("v", F.explode(F.array(*map(part, range(len(ranges))))).alias("x")).where("x is not null")
        counts: dict[tuple, list] = {}
        for r in seen.groupBy("x.i", "x.b").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "b").collect():
            counts.setdefault(ranges[r["i"]], []).append((r["n"], r["lo"], r["hi"]))
        for k, (place, lo, hi) in open_.items():
            for size, a, b in counts[lo, hi]:
                if place < size:
                    open_[k] = (place, a, b)
                    break
                place -= size
    out = []
    for p in at:
        a, b, share = found[int(p)], found[min(int(p) + 1, n - 1)], p - int(p)
        out.append(a if a == b else (1 - share) * a + share * b)
    return out

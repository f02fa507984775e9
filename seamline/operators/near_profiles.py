"""Candidates for the best cases of each query, out of cells of alike profiles.

Cases and queries are sorted together by what weighs most (class, count, shares, then a curve
through extent, size and spacing) in ranges, and each range is cut into cells of bounded
size. A query's k-th best score in its own cell is a score that k cases reach; ends of the
cells' numbers bound what any of their cases can reach. So pages of cells meet the
queries with their bounds only, and of the cases just those of cells whose bound reaches a query's
k-th score are scored. This chooses candidates; scores and ranks are computed from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.sources.tables import kept

#: Numbers of a profile as the arrays hold them: class number, then these (null: NaN).
NUMBERS = ("n_instances", "extent_ratio", "mean_nn_norm", "small", "medium", "large", "elongated", "mean_d")
WIDTH = 1 + len(NUMBERS)
KIND, N, EXTENT, NEAR, SMALL, MEDIUM, LARGE, LONG, SIZE = range(WIDTH)
#: Numbers without which a profile has no score.
NEEDED = [N, SMALL, MEDIUM, LARGE, LONG, SIZE]
SLACK = 1e-8
LARGEST, LEAST = 1024, 128


def curve() -> Column:
    """Place on a curve through extent, size and spacing, all in steps of equal weight."""
    step = lambda c, top: F.least(F.greatest(F.coalesce(F.floor(c), F.lit(0)), F.lit(0)), F.lit(top)).cast("bigint")
    of = [step(F.col("extent_ratio") * 1000, 1023), step((F.log(F.greatest("mean_d", F.lit(1e-3))) + 7) * 60, 1023), step(F.col("mean_nn_norm") * 150, 255)]
    bits = [F.shiftleft(F.shiftright(v, b).bitwiseAND(1), 3 * b + i) for i, v in enumerate(of) for b in range(10)]
    return reduce(Column.__add__, bits)


def scores(q: np.ndarray, c: np.ndarray, of: np.ndarray, closest: np.ndarray) -> np.ndarray:
    """An upper bound of the scores between boxes q and c (lo and hi of WIDTH numbers each, so
    2 * WIDTH columns): the score itself where both are points. of: similarities of classes;
    closest: the weights, of coarse parts and of the fine one. No number: -inf."""
    lo, hi = (lambda x, k: x[..., k]), (lambda x, k: x[..., WIDTH + k])

    def gap(k: int) -> np.ndarray:
        return np.maximum(np.maximum(lo(c, k) - hi(q, k), lo(q, k) - hi(c, k)), 0.0)

    def relative(k: int, least: float) -> np.ndarray:
        # the larger of the two nearest ends
        return gap(k) / np.maximum(np.maximum(np.where(lo(c, k) > hi(q, k), lo(c, k), lo(q, k)), least), 1e-300)

    with np.errstate(invalid="ignore"):
        one = (lo(q, KIND) == hi(q, KIND)) & (lo(c, KIND) == hi(c, KIND))
        at = np.where(one, lo(q, KIND) * CLASSES + lo(c, KIND), 0).astype(np.int64)
        both = np.where(one, np.where((at >= 0) & (at < len(of)), of[np.clip(at, 0, len(of) - 1)], np.nan), 1.0)
        missing = lambda k: np.isnan(lo(q, k)) | np.isnan(lo(c, k))
        close = lambda k: 1 - np.minimum(gap(k), 1.0)
        no_extent, no_near = missing(EXTENT), missing(NEAR)
        extent, near = close(EXTENT), close(NEAR)
        dist = np.where(no_extent, both, 0.6 * both + 0.4 * extent)
        shape = 1 - gap(LONG)
        size = 1 - (gap(SMALL) + gap(MEDIUM) + gap(LARGE)) / 2
        fine = (1 - np.minimum(relative(N, 1.0), 1.0) + 1 - np.minimum(relative(SIZE, 1e-6), 1.0) + np.where(no_extent, 0.5, extent) + np.where(no_near, 0.5, near)) / 4
        w = closest
        out = (dist * w[0] + shape * w[1] + size * w[2]) / w[:3].sum() * (1 - w[3]) + fine * w[3]
    return np.where(np.isnan(out), -np.inf, out)


#: Number of classes in the table of similarities.
CLASSES = 5


def points(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x], axis=-1)


def boxes(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """lo and hi of the stretches of rows (or boxes) that begin at starts; numbers that are
    missing count for nothing but in a stretch of them."""
    lo, hi = x[:, :WIDTH], x[:, -WIDTH:]
    return np.concatenate([np.fmin.reduceat(lo, starts), np.fmax.reduceat(hi, starts)], axis=1)


def mixed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """boxes() of boxes, with room for all where only some have no extent or spacing."""
    out = boxes(x, starts)
    for k in (EXTENT, NEAR):
        no = np.add.reduceat(np.isnan(x[:, k]).astype(np.int64), starts)
        some = (no > 0) & (no < np.diff(np.append(starts, len(x))))
        # half of a missing number is below the whole of one that fits
        out[some, k], out[some, WIDTH + k] = -np.inf, np.inf
        if k == EXTENT:
            out[some, KIND], out[some, WIDTH + KIND] = -np.inf, np.inf
    return out


def spans(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches: the number of the stretch and the place, of every place in them."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def cut(hard: np.ndarray, soft: np.ndarray) -> list[int]:
    """Starts of cells: at every hard border, at soft ones once LEAST rows are in a cell,
    and after LARGEST rows."""
    out, n = [0], len(hard)
    for a, b in zip((at := np.append(0, np.flatnonzero(hard | soft)).tolist()), [*at[1:], n]):
        if a and (hard[a] or a - out[-1] >= LEAST):
            out.append(a)
        while b - out[-1] > LARGEST:
            out.append(out[-1] + LARGEST)
    return sorted(set(out))


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list for each start, of what follows it."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(np.ascontiguousarray(values), kind))


CELL = "cell long, box array<double>, ids array<long>, numbers array<double>, verdicts array<string>, classes array<string>, q_ids array<long>, q_numbers array<double>, least array<double>"
SPARE = ("q_ids", "q_numbers", "least")


def in_cells(rows: DataFrame, k: int, of: np.ndarray, weights: np.ndarray) -> DataFrame:
    """Cells (columns: see CELL) of rows (query, image, distribution, kind, NUMBERS, verdict), with the
    queries that lie in them and their k-th best score there."""
    names = [x.split()[0] for x in CELL.split(", ")]

    def cells(part: list[pa.RecordBatch], first: int, at: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        x = np.column_stack([t.column(c).to_numpy().astype(np.float64) for c in ("kind", *NUMBERS)])
        # a profile without a class has no score with any other
        x[:, KIND] = np.where(np.isnan(x[:, KIND]), -100, x[:, KIND])
        asks, ids = t.column("query").to_numpy(), t.column("image").to_numpy()
        same = lambda k: (x[1:, k] == x[:-1, k]) | (np.isnan(x[1:, k]) & np.isnan(x[:-1, k]))
        hard = np.append(False, ~same(KIND) | (np.isnan(x[1:, EXTENT]) != np.isnan(x[:-1, EXTENT])) | (np.isnan(x[1:, NEAR]) != np.isnan(x[:-1, NEAR])))
        soft = np.append(False, ~(same(N) & same(LONG) & same(SMALL) & same(MEDIUM)))
        starts = np.array(cut(hard, soft))
        n = len(starts)
        of_row = np.repeat(np.arange(n), np.diff(np.append(starts, len(x))))
        c_at, q_at = np.flatnonzero(~asks), np.flatnonzero(asks)
        c_from, q_from = (np.searchsorted(of_row[y], np.arange(n)) for y in (c_at, q_at))
        box, least = np.full((n, 2 * WIDTH), np.nan), np.full(len(q_at), -np.inf)
        full = np.flatnonzero(np.diff(np.append(c_from, len(c_at))) > 0)
        if len(full):
            box[full] = boxes(x[c_at], c_from[full])
        for cell in full.tolist():
            some = np.arange(q_from[cell], q_from[cell + 1] if cell + 1 < n else len(q_at))
            c = x[c_at[c_from[cell] : c_from[cell + 1] if cell + 1 < n else len(c_at)]]
            if len(some) and len(c) >= k:
                least[some] = np.partition(scores(points(x[q_at[some]])[:, None], points(c)[None], of, weights), len(c) - k, axis=1)[:, len(c) - k]
        texts = [pa.ListArray.from_arrays(pa.array(np.append(c_from, len(c_at)).astype(np.int32)), t.column(c).combine_chunks().take(pa.array(c_at))) for c in ("verdict", "distribution")]
        columns = [
            pa.array(np.arange(n) + at + (first << 32)), lists(box.ravel(), np.arange(n) * 2 * WIDTH, pa.float64()), lists(ids[c_at], c_from, pa.int64()), lists(x[c_at].ravel(), c_from * WIDTH, pa.float64()),
            *texts, lists(ids[q_at], q_from, pa.int64()), lists(x[q_at].ravel(), q_from * WIDTH, pa.float64()), lists(least, q_from, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at, part, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            part.append(batch)
            held += batch.num_rows
            if held >= 100_000:
                yield (out := cells(part, first, at))
                at, part, held = at + out.num_rows, [], 0
        if held:
            yield cells(part, first, at)

    empty = [F.col(c).isNull() for c in ("extent_ratio", "mean_nn_norm")]
    placed = rows.withColumn("_curve", curve())
    order = [F.col("kind"), *empty, *(F.col(c) for c in ("n_instances", "elongated", "small", "medium", "_curve", "image", "query"))]
    return kept(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_curve").mapInArrow(run, CELL), "profile-cells")


def flat(column, width: int = 0) -> np.ndarray:
    out = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return out.reshape(-1, width) if width else out


MEETING = "cell long, q_ids array<long>, q_numbers array<double>, least array<double>"


def met(cells: DataFrame, of: np.ndarray, weights: np.ndarray, page: int = 4096, block: int = 256, group: int = 64) -> DataFrame:
    """Which cells can hold a query's best cases (columns: see MEETING): pages of cells' bounds
    against blocks of cells' queries. Bounds go from groups of cells to cells and from the queries
    of a cell to each query."""

    def packed(rows: DataFrame, kinds: str, most: int) -> DataFrame:
        """Rows of arrays, `most` rows as one."""
        names = [x.split()[0] for x in kinds.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, most):
                    part = batch.slice(k, most)
                    columns = []
                    for name in names:
                        if name == "sizes":
                            columns.append(np.diff(part.column("q_ids").offsets.to_numpy()).astype(np.int64))
                        else:
                            columns.append(part.column(name).to_numpy() if name == "cell" else flat(part.column(name)))
                    yield pa.RecordBatch.from_arrays([lists(c, np.zeros(1), pa.from_numpy_dtype(c.dtype)) for c in columns], names)

        return rows.mapInArrow(run, kinds)

    pages = packed(cells.where(F.size("ids") > 0).select("cell", "box"), "cell array<long>, box array<double>", page)
    asking = packed(cells.where(F.size("q_ids") > 0).select(*SPARE), "sizes array<long>, q_ids array<long>, q_numbers array<double>, least array<double>", block)
    both = asking.repartition(asking.sparkSession.sparkContext.defaultParallelism * 4).crossJoin(kept(pages, "cell-pages"))

    def reached(q: np.ndarray, c: np.ndarray, least: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs i, j of boxes those whose bound reaches least."""
        good = []
        for a in range(0, len(i), 100_000):
            x, y = i[a : a + 100_000], j[a : a + 100_000]
            good.append(scores(q[x], c[y], of, weights) + SLACK >= least[x])
        good = np.concatenate(good) if good else np.zeros(0, bool)
        return i[good], j[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch.column(name)[r].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}
                sizes, q, least, c = one["sizes"], one["q_numbers"].reshape(-1, WIDTH), one["least"], one["box"].reshape(-1, 2 * WIDTH)
                begin = np.cumsum(sizes) - sizes
                odd = np.isnan(q[:, NEEDED]).any(axis=1)
                q_box, lowest = boxes(q, begin), np.minimum.reduceat(np.where(odd, -np.inf, least), begin)
                top = np.arange(0, len(c), group)
                i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sizes)), np.arange(len(top)), indexing="ij"))
                i, j = reached(q_box, mixed(c, top), lowest, i, j)
                at, j = spans(top[j], np.minimum(top[j] + group, len(c)) - top[j])
                i, j = reached(q_box, c, lowest, i[at], j)
                at, i = spans(begin[i], sizes[i])
                i, j = reached(points(q), c, least, i, j[at])
                if not len(i):
                    continue
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                # a row holds 2,000 queries of a cell at most
                place = np.arange(len(j)) - np.searchsorted(j, j)
                starts = np.flatnonzero(place % 2000 == 0)
                yield pa.RecordBatch.from_arrays([pa.array(one["cell"][j[starts]]), lists(one["q_ids"][i], starts, pa.int64()), lists(q[i].ravel(), starts * WIDTH, pa.float64()), lists(least[i], starts, pa.float64())], [x.split()[0] for x in MEETING.split(", ")])

    return both.mapInArrow(run, MEETING)


def candidates(cells: DataFrame, meetings: DataFrame, k: int, of: np.ndarray, weights: np.ndarray) -> DataFrame:
    """query_id, case_id, verdict, distribution and the numbers of the case (KIND and NUMBERS): of each
    query and cell the pairs that may be among the query's k best, ties included."""
    names = ["query_id", "case_id", "verdict", "distribution", "kind", *NUMBERS]
    both = meetings.join(cells.select("cell", "ids", "numbers", "verdicts", "classes"), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch.column(name)[r].values for name in ("q_ids", "q_numbers", "least", "ids", "numbers", "verdicts", "classes")}
                q, c = (one[x].to_numpy(zero_copy_only=False).reshape(-1, WIDTH) for x in ("q_numbers", "numbers"))
                q_ids, ids, least = (one[x].to_numpy(zero_copy_only=False) for x in ("q_ids", "ids", "least"))
                for a in range(0, len(q), 256):
                    s = scores(points(q[a : a + 256])[:, None], points(c)[None], of, weights)
                    best = np.partition(s, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(s), -np.inf)
                    none = np.isneginf(s)
                    keep = ~none & (s + SLACK >= np.maximum(least[a : a + 256], best)[:, None])
                    # pairs without a score only fill up, smallest ids first
                    fill = np.flatnonzero(none.any(axis=1) & np.isneginf(least[a : a + 256]))
                    for x in fill.tolist():
                        y = np.flatnonzero(none[x])
                        keep[x, y[np.argsort(ids[y], kind="stable")[:k]]] = True
                    i, j = np.nonzero(keep)
                    if not len(i):
                        continue
                    at = pa.array(j)
                    numbers = [pa.array(c[j, n], mask=np.isnan(c[j, n])) for n in range(WIDTH)]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + i]), pa.array(ids[j]), one["verdicts"].take(at), one["classes"].take(at), *numbers], names)

    return both.mapInArrow(run, "query_id long, case_id long, verdict string, distribution string, " + ", ".join(f"{n} double" for n in names[4:]))

"""Acceptance tables as expressions: points, limits, ignored sizes, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the acceptance tables.
#: Points by major diameter in mm: up to 1, 2, 3, 4, 6, 8, and above.
POINTS = ((1.0, 1), (2.0, 2), (3.0, 3), (4.0, 6), (6.0, 10), (8.0, 15))
POINTS_ABOVE = 25
#: By thickness in mm up to: view window, largest diameter in mm, most points. A function is of the thickness.
LIMITS = (
    (10.0, "10x10", 4.0, 6),
    (25.0, "10x10", 5.0, 12),
    (50.0, "10x20", lambda t: t / 5.0, 24),
    (None, "10x20", 10.0, 30),
)
#: By thickness in mm up to: length limit in mm.
LENGTHS = ((12.0, 6.0), (50.0, lambda t: t / 2.0), (None, 24.0))
#: By thickness in mm up to: sizes in mm that do not count, up to and with this one.
IGNORED = ((25.0, 0.5), (None, 0.7))
#: Grades by margin; provisional, so they are a parameter everywhere.
GRADES = (0.5, 1.0, 2.0)


def steps(value: Column, table, above) -> Column:
    """Look-up in (upper bound, result) rows: the first whose bound is not exceeded."""
    out = None
    for bound, result in table:
        out = F.when(value <= bound, result) if out is None else out.when(value <= bound, result)
    return out.otherwise(above)


def points(d: Column) -> Column:
    return steps(d, POINTS, POINTS_ABOVE)


def by_thickness(t: Column, table, column: int = 1) -> Column:
    """Look-up of a thickness in a table whose last row has no bound."""
    value = lambda row: row[column](t) if callable(row[column]) else F.lit(row[column])
    return steps(t, [(row[0], value(row)) for row in table[:-1]], value(table[-1]))


def field(t: Column) -> Column:
    """The view window that a thickness is judged in (a label)."""
    return by_thickness(t, LIMITS, 1)


def size_limit(t: Column) -> Column:
    """Largest allowed diameter in mm."""
    return by_thickness(t, LIMITS, 2)


def point_limit(t: Column) -> Column:
    return by_thickness(t, LIMITS, 3)


def length_limit(t: Column) -> Column:
    return by_thickness(t, LENGTHS)


def ignored_up_to(t: Column) -> Column:
    return by_thickness(t, IGNORED)


def grade(margin: Column, hard: Column | None = None, bounds=GRADES) -> Column:
    """1 to 4; a hard defect is 4 whatever the margin."""
    out = steps(margin, tuple((b, i + 1) for i, b in enumerate(bounds)), 4)
    return out if hard is None else F.when(hard, 4).otherwise(out)

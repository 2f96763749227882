"""Joins of rows that lie within a tolerance on several axes, by equal cells instead of all pairs of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint if ``df`` has few rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def cell(column: str, width: float):
    return F.floor(F.col(column) / width)


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], axes: list[tuple[str, str, float]]) -> DataFrame:
    """Pairs of ``left`` and ``right`` of one key whose cells touch: a superset of those within ``width`` on every
    axis (left column, right column, width), each pair once.  A left row goes to 3^axes cells; columns of the
    two sides must differ but for the keys."""
    own = [f"_cell{i}" for i in range(len(axes))]
    a, b = left, right
    for name, (x, y, width) in zip(own, axes):
        a = a.withColumn(name, F.explode(F.array(*[cell(x, width) + o for o in (-1, 0, 1)])))
        b = b.withColumn(name, cell(y, width))
    return a.join(b, [*keys, *own]).drop(*own)

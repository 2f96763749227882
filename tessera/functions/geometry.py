"""Column expressions on planar points and 2x3 affine poses (a b tx / c d ty).

A pose is a struct or six columns; points are columns ``x`` (column axis) and ``y`` (row axis).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSE = ("a", "b", "tx", "c", "d", "ty")
#: Reference point whose image tells where a field lands, in pixels.
PROBE = (300.0, 300.0)
# Beyond these two poses are clearly different, in degrees and pixels.
CLEAR_ANGLE, CLEAR_LANDING = 3.0, 60.0


def pose(values) -> Column:
    """Literal pose struct from six numbers."""
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(POSE, values)])


def move_x(m: Column, x: Column, y: Column) -> Column:
    return m["a"] * x + m["b"] * y + m["tx"]


def move_y(m: Column, x: Column, y: Column) -> Column:
    return m["c"] * x + m["d"] * y + m["ty"]


def det(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def angle(m: Column) -> Column:
    """Rotation in degrees."""
    return F.degrees(F.atan2(m["c"], m["a"]))


def scale(m: Column) -> Column:
    return F.sqrt(F.abs(det(m)))


def anisotropy(m: Column) -> Column:
    """Ratio of the singular values minus one, in closed form; infinite for a singular pose."""
    q = m["a"] * m["a"] + m["b"] * m["b"] + m["c"] * m["c"] + m["d"] * m["d"]
    root = F.sqrt(F.greatest(q * q - 4.0 * det(m) * det(m), F.lit(0.0)))
    small = F.sqrt(F.greatest((q - root) / 2.0, F.lit(0.0)))
    return F.when(small > 0, F.sqrt((q + root) / 2.0) / small - 1.0).otherwise(F.lit(float("inf")))


def landing_x(m: Column, ox: Column, oy: Column) -> Column:
    return m["a"] * (F.lit(PROBE[0]) - ox) + m["b"] * (F.lit(PROBE[1]) - oy) + m["tx"]


def landing_y(m: Column, ox: Column, oy: Column) -> Column:
    return m["c"] * (F.lit(PROBE[0]) - ox) + m["d"] * (F.lit(PROBE[1]) - oy) + m["ty"]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def clearly_different(angle1, x1, y1, angle2, x2, y2, angle_tol: float = CLEAR_ANGLE, landing_tol: float = CLEAR_LANDING) -> Column:
    """More than ``angle_tol`` degrees or ``landing_tol`` pixels apart; both bounds strict."""
    return (F.abs(angle1 - angle2) > angle_tol) | (distance(x1, y1, x2, y2) > landing_tol)


def compose(outer: Column, inner: Column) -> Column:
    """outer after inner, as a pose struct."""
    o, i = outer, inner
    parts = (
        o["a"] * i["a"] + o["b"] * i["c"], o["a"] * i["b"] + o["b"] * i["d"], o["a"] * i["tx"] + o["b"] * i["ty"] + o["tx"],
        o["c"] * i["a"] + o["d"] * i["c"], o["c"] * i["b"] + o["d"] * i["d"], o["c"] * i["tx"] + o["d"] * i["ty"] + o["ty"],
    )
    return F.struct(*[p.alias(n) for n, p in zip(POSE, parts)])


def subject(sample_id: Column) -> Column:
    return F.split_part(sample_id, F.lit("__"), F.lit(1))


def region(sample_id: Column) -> Column:
    return F.split_part(sample_id, F.lit("__"), F.lit(2))


def sample_path(sample_id: Column) -> Column:
    return F.replace(sample_id, F.lit("__"), F.lit("/"))


def cell_name(prefix: str, ordinal: Column) -> Column:
    return F.format_string(prefix + "_%06d", ordinal.cast("long"))

"""Plane geometry on coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubled_area(p, q, r) -> Column:
    """Twice the signed area of the triangle p, q, r: positive when r lies to the left of the way from p to q."""
    (px, py), (qx, qy), (rx, ry) = p, q, r
    return (qx - px) * (ry - py) - (rx - px) * (qy - py)


def parts(p, q, r, s) -> Column:
    """Does the line through p and q part r from s? A point on the line counts as lying to its right."""
    return (doubled_area(p, q, r) > 0) != (doubled_area(p, q, s) > 0)


def segments_cross(p, q, r, s) -> Column:
    """Do the segments p-q and r-s cross, each parting the other's ends? Points are (x, y) pairs of columns.

    An end that touches the other segment crosses it from the left side only; of two
    segments on one line neither parts the other.
    """
    return parts(p, q, r, s) & parts(r, s, p, q)


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / F.when(l2 == 0, F.lit(1.0)).otherwise(l2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))

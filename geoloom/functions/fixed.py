"""Measures of segments against one polygon that is the same for all rows, as Column functions over Arrow batches.

The forms in ``geometry`` take a polygon of each row and fold it by higher-order functions, which run interpreted, edge by
edge. Where the polygon is given once, numpy takes a batch of segments an edge. Formulas and their order are those of
``geometry`` and ``profile``; a distance to a null coordinate is left out of the least one there and here, as in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import _ON, KM_PER_DEG, KM_PER_LAT, KM_PER_LON, SLACK_KM, SLACK_PART

Vertices = Sequence[Sequence[float]]


def _edges(vertices: Vertices) -> list[tuple[float, float, float, float]]:
    """(ax, ay, bx, by), the edge into each vertex."""
    return [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip([vertices[-1], *vertices[:-1]], vertices)]


def _inside(px, py, edges):
    odd = np.zeros(np.shape(px), bool)
    for ax, ay, bx, by in edges:
        if ay != by:
            odd ^= ((by > py) != (ay > py)) & (px < (ax - bx) * (py - by) / (ay - by) + bx)
    return odd


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def _on(px, py, ax, ay, bx, by):
    return (px >= np.minimum(ax, bx) - _ON) & (px <= np.maximum(ax, bx) + _ON) & (py >= np.minimum(ay, by) - _ON) & (py <= np.maximum(ay, by) + _ON)


def _meet(ax, ay, bx, by, cx, cy, dx, dy):
    c, d = _cross(cx - ax, cy - ay, bx - ax, by - ay), _cross(dx - ax, dy - ay, bx - ax, by - ay)
    a, b = _cross(ax - cx, ay - cy, dx - cx, dy - cy), _cross(bx - cx, by - cy, dx - cx, dy - cy)
    proper = (np.sign(c) * np.sign(d) < 0) & (np.sign(a) * np.sign(b) < 0)
    touch = ((c == 0) & _on(cx, cy, ax, ay, bx, by)) | ((d == 0) & _on(dx, dy, ax, ay, bx, by)) | ((a == 0) & _on(ax, ay, cx, cy, dx, dy)) | ((b == 0) & _on(bx, by, cx, cy, dx, dy))
    return proper | touch


def _plane(px, py, ax, ay, bx, by):
    vx, vy = bx - ax, by - ay
    length2 = vx * vx + vy * vy
    t = np.where(length2 > 0, np.clip(((px - ax) * vx + (py - ay) * vy) / np.where(length2 > 0, length2, 1.0), 0, 1), 0.0)
    ex, ey = px - (ax + t * vx), py - (ay + t * vy)
    return np.sqrt(ex * ex + ey * ey)


def _measure(work: Callable[..., np.ndarray], vertices: Vertices, segment: Sequence[Column]) -> Column:
    """``work(ax, ay, bx, by, edges)`` of batches of segments; null below three vertices."""
    if len(vertices) < 3:
        return F.lit(None).cast("double")
    edges = _edges(vertices)

    def run(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series(work(*[v.to_numpy(float) for v in (ax, ay, bx, by)], edges))

    return F.pandas_udf(run, "double")(*segment)


def segment_polygon_km(ax: Column, ay: Column, bx: Column, by: Column, vertices: Vertices) -> Column:
    """``geometry.segment_polygon_km`` of a polygon that is given once."""

    def work(ax, ay, bx, by, edges):
        least = np.full(len(ax), np.nan)
        for cx, cy, dx, dy in edges:
            k = KM_PER_LON * np.cos(np.radians((ay + cy) / 2))
            p = (ax * k, ay * KM_PER_LAT, bx * k, by * KM_PER_LAT)
            q = (cx * k, cy * KM_PER_LAT, dx * k, dy * KM_PER_LAT)
            apart = np.fmin(np.fmin(_plane(*p[:2], *q), _plane(*p[2:], *q)), np.fmin(_plane(*q[:2], *p), _plane(*q[2:], *p)))
            least = np.fmin(least, np.where(_meet(*p, *q), 0.0, apart))
        return np.where(_inside(ax, ay, edges) | _inside(bx, by, edges), 0.0, least)

    return _measure(work, vertices, (ax, ay, bx, by))


def segment_polygon_deg(ax: Column, ay: Column, bx: Column, by: Column, vertices: Vertices) -> Column:
    """``geometry.segment_polygon_deg`` of a polygon that is given once."""

    def work(ax, ay, bx, by, edges):
        return np.fmin.reduce([np.fmin(_plane(ax, ay, *e), _plane(bx, by, *e)) for e in edges])

    return _measure(work, vertices, (ax, ay, bx, by))


def inside_share(ax: Column, ay: Column, bx: Column, by: Column, vertices: Vertices) -> Column:
    """How much of a segment lies inside: ``profile.band_length`` of ``profile.segment_bands`` for a length of one. Cuts are
    sorted; between equal ones nothing is added, so they need not be told apart."""

    def work(ax, ay, bx, by, edges):
        dx, dy = bx - ax, by - ay
        cuts = [np.zeros(len(ax)), np.ones(len(ax))]
        for cx, cy, ex, ey in edges:
            wx, wy = ex - cx, ey - cy
            det = _cross(dx, dy, wx, wy)
            some = np.where(det != 0, det, 1.0)
            t, u = _cross(cx - ax, cy - ay, wx, wy) / some, _cross(cx - ax, cy - ay, dx, dy) / some
            cuts.append(np.where((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), t, 1.0))
        cuts = np.sort(np.array(cuts), axis=0)
        total = np.zeros(len(ax))
        for t0, t1 in zip(cuts[:-1], cuts[1:]):
            m = (t0 + t1) / 2
            total = total + np.where(_inside(ax + dx * m, ay + dy * m, edges), t1 - t0, 0.0)
        return total

    return _measure(work, vertices, (ax, ay, bx, by))


def circle_interval(ax: Column, ay: Column, bx: Column, by: Column, cx: float, cy: float, radius_km: float) -> Column:
    """``geometry.segment_circle_interval`` of a circle that is given once, as (t0, t1): both null where that is null."""

    def run(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        ax, ay, bx, by = (v.to_numpy(float) for v in (ax, ay, bx, by))
        with np.errstate(divide="ignore", invalid="ignore"):
            east = np.cos(np.radians((ay + by) / 2)) * KM_PER_DEG
            run_, rise = (bx - ax) * east, (by - ay) * KM_PER_DEG
            length = np.sqrt(run_ * run_ + rise * rise)
            middle = ((cx - ax) * east * run_ + (cy - ay) * KM_PER_DEG * rise) / (length * length)
            off_x, off_y = (cx - ax) * east - middle * run_, (cy - ay) * KM_PER_DEG - middle * rise
            wide = radius_km + np.maximum(length * SLACK_PART, SLACK_KM)
            spare = wide * wide - (off_x * off_x + off_y * off_y)
            half = np.sqrt(np.maximum(spare, 0.0)) / length
            t0, t1 = np.clip(middle - half, 0, 1), np.clip(middle + half, 0, 1)
            met = (length >= 1e-6) & (spare > 0) & (t1 > 0) & (t0 < 1)
        return pd.DataFrame({"t0": np.where(met, t0, np.nan), "t1": np.where(met, t1, np.nan)})

    return F.pandas_udf(run, "t0 double, t1 double")(ax, ay, bx, by)

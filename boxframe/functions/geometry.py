"""Geometry of boxes as Column expressions; a box is four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return Box(*[F.col(prefix + n) for n in names])


def area(b: Box) -> Column:
    """May be negative for a box turned inside out."""
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    high = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def valid(b: Box) -> Column:
    return (b.x1 < b.x2) & (b.y1 < b.y2)


def iou(a: Box, b: Box, mode: str = "safe") -> Column:
    """Intersection over union.

    safe: 0 for degenerate boxes, held within 0 and 1. strict: degenerate boxes raise. eval: no
    check; null where the union is empty.
    """
    inter = intersection(a, b)
    plain = F.try_divide(inter, area(a) + area(b) - inter)
    if mode == "eval":
        return plain
    good = valid(a) & valid(b)
    if mode == "strict":
        return F.when(good, plain).otherwise(F.raise_error(F.lit("degenerate box")).cast("double"))
    return F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), plain))).otherwise(F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    """Share of `inner` that lies in `outer`; 0 unless they overlap strictly."""
    inter = intersection(inner, outer)
    return F.when(inter > 0, inter / F.greatest(area(inner), F.lit(1e-6))).otherwise(F.lit(0.0))


def center_distance(a: Box, b: Box) -> Column:
    dx = (a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2
    dy = (a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2
    return F.sqrt(dx * dx + dy * dy)


def scaled_within(b: Box, width, height, scale: float = 1.5) -> Box:
    """The box scaled about its centre and clamped to the image; nulls if nothing is left."""
    cx, cy = (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2
    w, h = (b.x2 - b.x1) * scale, (b.y2 - b.y1) * scale
    low_x, low_y = F.greatest(F.lit(0.0), cx - w / 2), F.greatest(F.lit(0.0), cy - h / 2)
    high_x, high_y = F.least(F.lit(float(width)), cx + w / 2), F.least(F.lit(float(height)), cy + h / 2)
    good = (low_x < high_x) & (low_y < high_y)
    return Box(*[F.when(good, c) for c in (low_x, low_y, high_x, high_y)])


def normalised(b: Box, width, height, digits: int = 4) -> Box:
    return Box(*[F.round(c / F.lit(float(s)), digits) for c, s in zip(b, (width, height, width, height))])


def denormalised(b: Box, width, height) -> Box:
    return Box(*[c * F.lit(float(s)) for c, s in zip(b, (width, height, width, height))])


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def to_centre(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def from_grid(reply: Column, width, height) -> Box:
    """A model's box [ymin, xmin, ymax, xmax] on a 0-1000 grid in pixels."""
    at = lambda i, size: F.get(reply, F.lit(i)) / 1000 * F.lit(float(size))
    return Box(at(1, width), at(0, height), at(3, width), at(2, height))


def drawable(b: Box, width, height) -> Column:
    return valid(b) & (b.x1 >= 0) & (b.y1 >= 0) & (b.x2 <= width) & (b.y2 <= height)


def colour(i: Column, n: int) -> Column:
    """Hex colour i of n round the hue wheel, with saturation and value that alternate."""
    hue, s, v = i / F.lit(float(n)), F.lit(0.7) + (i % 3) * 0.1, F.lit(0.8) + (i % 2) * 0.2

    def channel(k: int) -> Column:
        turn = F.pmod(F.lit(float(k)) + hue * 6, F.lit(6.0))
        part = v - v * s * F.greatest(F.lit(0.0), F.least(turn, 4 - turn, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(part * 255).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), channel(5), channel(3), channel(1))

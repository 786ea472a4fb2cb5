"""Axis-aligned boxes as four double columns; all helpers are Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column

    @property
    def width(self) -> Column:
        return self.max_x - self.min_x

    @property
    def height(self) -> Column:
        return self.max_y - self.min_y

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.min_x + self.max_x) / 2

    @property
    def center_y(self) -> Column:
        return (self.min_y + self.max_y) / 2

    @property
    def empty(self) -> Column:
        return (self.width <= 0) | (self.height <= 0)

    def columns(self) -> list[Column]:
        return [self.min_x.alias("min_x"), self.min_y.alias("min_y"), self.max_x.alias("max_x"), self.max_y.alias("max_y")]


def box(prefix: str = "") -> Box:
    """The box whose columns, or a struct's fields, have this prefix."""
    return Box(*(F.col(f"{prefix}{n}") for n in ("min_x", "min_y", "max_x", "max_y")))


def box_of(value: Column) -> Box:
    """The box in a struct, as a lambda's argument is."""
    return Box(*(value[n] for n in ("min_x", "min_y", "max_x", "max_y")))


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.max_x, b.max_x) - F.greatest(a.min_x, b.min_x))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.max_y, b.max_y) - F.greatest(a.min_y, b.min_y))


def intersection(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def iou(a: Box, b: Box, pixel: float = 0.0) -> Column:
    """Intersection over union, 0 if there is no union; pixel is added to widths and heights."""
    w = F.greatest(F.lit(0.0), F.least(a.max_x, b.max_x) - F.greatest(a.min_x, b.min_x) + pixel)
    h = F.greatest(F.lit(0.0), F.least(a.max_y, b.max_y) - F.greatest(a.min_y, b.min_y) + pixel)
    both = w * h
    union = (a.width + pixel) * (a.height + pixel) + (b.width + pixel) * (b.height + pixel) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    least = F.least(a.area, b.area)
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def contained(inner: Box, outer: Box, ratio: float = 0.9) -> Column:
    """At least so much of inner's area is in outer."""
    return F.when(inner.area > 0, intersection(inner, outer) / inner.area >= ratio).otherwise(F.lit(False))


def within(inner: Box, outer: Box) -> Column:
    return (inner.min_x >= outer.min_x) & (inner.min_y >= outer.min_y) & (inner.max_x <= outer.max_x) & (inner.max_y <= outer.max_y)


def translate(b: Box, dx, dy) -> Box:
    return Box(b.min_x + dx, b.min_y + dy, b.max_x + dx, b.max_y + dy)


def scale(b: Box, sx, sy) -> Box:
    return Box(b.min_x * sx, b.min_y * sy, b.max_x * sx, b.max_y * sy)


def clamp(value: Column, low, high) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(wrap(low), F.least(wrap(high), value))


def rotate(b: Box, degrees: int, width, height) -> Box:
    """The box in the frame of a page of that width and height turned clockwise by 0, 90, 180 or 270 degrees."""
    if degrees == 0:
        return b
    if degrees == 90:
        return Box(height - b.max_y, b.min_x, height - b.min_y, b.max_x)
    if degrees == 180:
        return Box(width - b.max_x, height - b.max_y, width - b.min_x, height - b.min_y)
    if degrees == 270:
        return Box(b.min_y, width - b.max_x, b.max_y, width - b.min_x)
    raise ValueError("degrees must be 0, 90, 180 or 270")


def rotate_back(b: Box, degrees: int, width, height) -> Box:
    """From the turned frame of a page of that original width and height to its own."""
    if degrees in (0, 180):
        return rotate(b, degrees, width, height)
    return rotate(b, 360 - degrees, height, width)


def rotate_point(x: Column, y: Column, angle: Column, cx, cy) -> tuple[Column, Column]:
    """The point turned by an angle in degrees about a centre, as undoing a deskew does."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def unclip(b: Box, ratio: float, width, height) -> Box:
    """The box scaled about its centre and cut to the page; empty ones are for the caller to drop."""
    hw, hh = b.width * ratio / 2, b.height * ratio / 2
    return Box(clamp(b.center_x - hw, 0, width), clamp(b.center_y - hh, 0, height), clamp(b.center_x + hw, 0, width), clamp(b.center_y + hh, 0, height))


def polygon_box(points: Column) -> Column:
    """The box of array<struct<x,y>>; an empty one gives zeros."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    zero = F.lit(0.0)
    return F.struct(F.coalesce(F.array_min(x), zero).alias("min_x"), F.coalesce(F.array_min(y), zero).alias("min_y"), F.coalesce(F.array_max(x), zero).alias("max_x"), F.coalesce(F.array_max(y), zero).alias("max_y"))


def valid_polygon(points: Column, width, height) -> Column:
    """At least three finite points on the page whose box has an area."""
    b = box_of(polygon_box(points))
    on_page = F.forall(points, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & p["x"].between(0.0, width) & p["y"].between(0.0, height))
    return F.coalesce((F.size(points) >= 3) & on_page & ~b.empty, F.lit(False))


def region_of_interest(x: Column, y: Column, w: Column, h: Column, normalized: Column, width, height) -> Box:
    """A pixel or fractional rectangle as whole pixels within the page, halves to even."""
    sx, sy = F.when(normalized, width).otherwise(1), F.when(normalized, height).otherwise(1)
    put = lambda v, top: clamp(F.bround(v).cast("double"), 0, top)
    return Box(put(x * sx, width), put(y * sy, height), put((x + w) * sx, width), put((y + h) * sy, height))

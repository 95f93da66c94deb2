"""Rectangles as columns: overlap measures, clamping, coordinate spaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    """Left, top, right, bottom: columns, or names of columns that are looked up on use."""

    left: Column | str
    top: Column | str
    right: Column | str
    bottom: Column | str

    @classmethod
    def of(cls, prefix: str = "") -> Rect:
        return cls(*(prefix + c for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def sized(cls, x: Column, y: Column, w: Column, h: Column) -> Rect:
        return cls(x, y, x + w, y + h)

    @staticmethod
    def _column(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    @property
    def x0(self) -> Column:
        return self._column(self.left)

    @property
    def y0(self) -> Column:
        return self._column(self.top)

    @property
    def x1(self) -> Column:
        return self._column(self.right)

    @property
    def y1(self) -> Column:
        return self._column(self.bottom)

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2


def intersection(a: Rect, b: Rect) -> Column:
    """Area that both cover; 0 where they only touch."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0.99 where more than 60 % of the smaller is covered."""
    both = intersection(a, b)
    return F.when(both == 0, 0.0).when(both / F.least(a.area, b.area) > 0.60, 0.99).otherwise(both / (a.area + b.area - both))


def overlap(a: Rect, b: Rect) -> Column:
    """The larger of intersection over union and intersection over the smaller area."""
    both = intersection(a, b)
    return F.when(both == 0, 0.0).otherwise(F.greatest(both / (a.area + b.area - both), both / F.least(a.area, b.area)))


def containment(small: Rect, big: Rect) -> Column:
    """Share of ``small`` inside ``big``; an area under one counts as one."""
    return intersection(small, big) / F.greatest(F.lit(1.0), small.area)


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance between two intervals, 0 if they meet."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def holds(r: Rect, x: Column, y: Column, margin: float = 0) -> Column:
    """Is the point in the rectangle, its edge moved out by ``margin``?"""
    return (x >= r.x0 - margin) & (x <= r.x1 + margin) & (y >= r.y0 - margin) & (y <= r.y1 + margin)


def padded(r: Rect, pad_x: float, pad_y: float, width: Column, height: Column) -> Rect:
    """The rectangle grown and clamped to the page."""
    return Rect(F.greatest(F.lit(0), r.x0 - pad_x), F.greatest(F.lit(0), r.y0 - pad_y), F.least(width, r.x1 + pad_x), F.least(height, r.y1 + pad_y))


def normalized(r: Rect, width: Column, height: Column) -> list[Column]:
    """x, y, width, height in shares of the page, four decimals."""
    return [F.bround(c, 4) for c in (r.x0 / width, r.y0 / height, (r.x1 - r.x0) / width, (r.y1 - r.y0) / height)]


def pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least: int = 5) -> Rect:
    """Shares of the page to whole pixels inside it, ``least`` wide and high."""
    left = F.greatest(F.lit(0), F.least(F.floor(x * width), width - least))
    top = F.greatest(F.lit(0), F.least(F.floor(y * height), height - least))
    return Rect(left, top, F.least(width, left + F.greatest(F.lit(least), F.floor(w * width))), F.least(height, top + F.greatest(F.lit(least), F.floor(h * height))))


def turned(r: Rect, page_height: Column) -> Rect:
    """A rectangle of vertical text in the reading frame: x' = page height - y, y' = x."""
    return Rect(page_height - r.y1, r.x0, page_height - r.y0, r.x1)


def turned_back(x: Column, y: Column, width: Column) -> tuple[Column, Column]:
    """A point of a page turned a quarter counter-clockwise, in page pixels."""
    return width - 1 - y, x


def nearest_point(r: Rect, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """The point of the rectangle nearest to (x, y), and its distance."""
    px, py = F.greatest(r.x0, F.least(x, r.x1)), F.greatest(r.y0, F.least(y, r.y1))
    return px, py, F.hypot(px - x, py - y)


def has_leader(r: Rect, x: Column, y: Column, radius: Column) -> Column:
    """A label at (x, y) needs a leader line if the box is further than 0.9 of its radius."""
    return nearest_point(r, x, y)[2] > radius * 0.9


def moved(r: Rect, dx: Column, dy: Column, width: Column, height: Column) -> Rect:
    """Moved as a whole and kept inside the page."""
    w, h = r.x1 - r.x0, r.y1 - r.y0
    x, y = F.greatest(F.lit(0), F.least(r.x0 + dx, width - w)), F.greatest(F.lit(0), F.least(r.y0 + dy, height - h))
    return Rect(x, y, x + w, y + h)


def resized(r: Rect, dx: Column, dy: Column, width: Column, height: Column, least: int = 10) -> Rect:
    """The lower right corner moved, ``least`` at least remaining, inside the page."""
    return Rect(r.x0, r.y0, F.least(width, F.greatest(r.x0 + least, r.x1 + dx)), F.least(height, F.greatest(r.y0 + least, r.y1 + dy)))

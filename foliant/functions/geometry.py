"""Rectangles as arrays [x0, y0, x1, y1] of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import constants as K

#: Height of a band of a page, in points.
BAND = 72.0


def rect(*sides: Column | float) -> Column:
    return F.array(*[s if isinstance(s, Column) else F.lit(float(s)) for s in sides])


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area over the smaller area; 0 for touching or empty rectangles."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    smaller = F.least(area(a), area(b))
    return F.when((width > 0) & (height > 0) & (smaller > 0), width * height / smaller).otherwise(F.lit(0.0))


def equivalent(a: Column, b: Column, tolerance: float = K.RECT_MATCH) -> Column:
    """Both of four sides, none further apart than the tolerance."""
    return F.coalesce((F.size(a) == 4) & (F.size(b) == 4) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda x: x), F.lit(False))


def rect_error(r: Column, box: Column, tolerance: float = K.RECT_BOUNDS_PLAN) -> Column:
    """What is wrong with a link's rectangle on a page of this media box; null if nothing."""
    odd = F.exists(r, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    outside = (r[0] < box[0] - tolerance) | (r[1] < box[1] - tolerance) | (r[2] > box[2] + tolerance) | (r[3] > box[3] + tolerance)
    return (
        F.when(r.isNull() | (F.size(r) != 4), F.lit("missing or malformed /Rect"))
        .when(F.exists(r, lambda x: x.isNull()), F.lit("non-numeric /Rect"))
        .when(odd, F.lit("non-finite /Rect"))
        .when((r[2] <= r[0]) | (r[3] <= r[1]), F.lit("empty or reversed /Rect"))
        .when(outside, F.lit("out-of-page /Rect"))
    )


def flip(x0: Column, top: Column, x1: Column, bottom: Column, height: Column) -> Column:
    """From a top-left origin to the bottom-left one of links."""
    return F.array(x0, height - bottom, x1, height - top)


def padded_flip(words: Column, width: Column, height: Column) -> Column:
    """The box around words (structs with x0, x1, top, bottom), padded, within the page, with bottom-left origin."""
    least = lambda f: F.array_min(F.transform(words, lambda w: w[f]))
    most = lambda f: F.array_max(F.transform(words, lambda w: w[f]))
    pad, zero = F.lit(K.RECT_PADDING), F.lit(0.0)
    return flip(F.greatest(zero, least("x0") - pad), F.greatest(zero, least("top") - pad), F.least(width, most("x1") + pad), F.least(height, most("bottom") + pad), height)


def bands(rect: Column) -> Column:
    """Numbers of the horizontal bands that a rectangle touches, in order: rectangles that overlap share one.

    What lies beyond any page, or isn't finite, counts to the outermost bands.
    """
    at = lambda y: F.floor(F.least(F.greatest(y, F.lit(-20.0 * BAND)), F.lit(200.0 * BAND)) / BAND)
    low, high = at(F.get(rect, F.lit(1))), at(F.get(rect, F.lit(3)))
    return F.sequence(F.least(low, high), F.greatest(low, high))

"""Boxes as structs (x0, y0, x1, y1) of doubles, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import constants as K


def box(x0, y0, x1, y1) -> Column:
    c = lambda v: (F.col(v) if isinstance(v, str) else F.lit(v)).cast("double")
    return F.struct(c(x0).alias("x0"), c(y0).alias("y0"), c(x1).alias("x1"), c(y1).alias("y1"))


def _b(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def area(b: Column | str) -> Column:
    b = _b(b)
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def scale(b: Column | str, from_width, from_height, to_width, to_height) -> Column:
    """A box in another page size; fails unless the source size is positive."""
    b, w, h = _b(b), F.lit(from_width), F.lit(from_height)
    sx, sy = F.lit(to_width) / w, F.lit(to_height) / h
    scaled = box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)
    return F.when((w > 0) & (h > 0), scaled).otherwise(F.raise_error(F.lit("image sizes must be positive")))


def clamp(b: Column | str, width, height) -> Column:
    b = _b(b)
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(most).cast("double")))
    return box(inside(b.x0, width), inside(b.y0, height), inside(b.x1, width), inside(b.y1, height))


def offset(b: Column | str, dx, dy) -> Column:
    b = _b(b)
    return box(b.x0 + F.lit(dx), b.y0 + F.lit(dy), b.x1 + F.lit(dx), b.y1 + F.lit(dy))


def normalize(b: Column | str) -> Column:
    """With corners in order."""
    b = _b(b)
    return box(F.least(b.x0, b.x1), F.least(b.y0, b.y1), F.greatest(b.x0, b.x1), F.greatest(b.y0, b.y1))


def is_degenerate(b: Column | str, least: float = K.DEGENERATE) -> Column:
    b = _b(b)
    return (b.x1 - b.x0 < least) | (b.y1 - b.y0 < least)


def intersection(a: Column | str, b: Column | str) -> Column:
    """The common box, or null; touching edges have none."""
    a, b = _b(a), _b(b)
    x0, y0, x1, y1 = F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)
    return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def iou(a: Column | str, b: Column | str) -> Column:
    common = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def polygon_box(points: Column | str) -> Column:
    """The envelope of an array of (x, y) arrays."""
    xs, ys = F.transform(_b(points), lambda p: p[0]), F.transform(_b(points), lambda p: p[1])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def unletterbox(b: Column | str, model_height, model_width, height, width) -> Column:
    """A box found on a padded, scaled image, on the image itself. Rounds half to even."""
    number = lambda v: (F.col(v) if isinstance(v, str) else F.lit(v)).cast("double")
    b, mh, mw, h, w = _b(b), *(number(v) for v in (model_height, model_width, height, width))
    gain = F.least(mh / h, mw / w)
    px, py = F.bround((mw - w * gain) / 2 - 0.1, 0), F.bround((mh - h * gain) / 2 - 0.1, 0)
    return box((b.x0 - px) / gain, (b.y0 - py) / gain, (b.x1 - px) / gain, (b.y1 - py) / gain)


def letterbox(height, width, model_height, model_width, stride: int = 32) -> Column:
    """Struct (height, width, top, bottom, left, right): resized size and padding to multiples of stride."""
    h, w, mh, mw = (F.lit(v).cast("double") for v in (height, width, model_height, model_width))
    r = F.least(mh / h, mw / w)
    rh, rw = F.bround(h * r, 0).cast("int"), F.bround(w * r, 0).cast("int")
    ph, pw = F.pmod(mh.cast("int") - rh, F.lit(stride)), F.pmod(mw.cast("int") - rw, F.lit(stride))
    half = lambda p: F.floor(p / 2).cast("int")
    return F.struct(rh.alias("height"), rw.alias("width"), half(ph).alias("top"), (ph - half(ph)).alias("bottom"), half(pw).alias("left"), (pw - half(pw)).alias("right"))


def crop_window(b: Column | str, page_width, page_height, image_width, image_height) -> Column:
    """Pixels (x0, y0, x1, y1) of a box on an image, truncated and clamped; null if empty."""
    b = _b(b)
    px = lambda v, page, image: F.greatest(F.lit(0), F.least((v * (F.lit(image) / F.lit(page))).cast("int"), F.lit(image).cast("int")))
    x0, x1 = px(b.x0, page_width, image_width), px(b.x1, page_width, image_width)
    y0, y1 = px(b.y0, page_height, image_height), px(b.y1, page_height, image_height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def pixel_region(b: Column | str, width, height) -> Column:
    """The pixels that a detection covers: grown by one, flipped to a lower left origin, truncated, clipped, half open."""
    b, w, h = _b(b), F.lit(width).cast("double"), F.lit(height).cast("double")
    clip = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), (most - 1).cast("int")))
    return F.struct(clip(b.x0 - 1, w).alias("x0"), clip(h - b.y1 - 1, h).alias("y0"), clip(b.x1 + 1, w).alias("x1"), clip(h - b.y0 + 1, h).alias("y1"))

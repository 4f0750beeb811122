"""Column functions on image sizes, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest image sides, paddings and the two regions of interest as (stage, bottom fraction, left fraction). Fixed values.
OCR_SIDE, CAPTURE_SIDE, PADDING = 1920, 1280, 0.02
PRESETS = (("bottom50_left60_mobile", 0.5, 0.6), ("bottom60_fullwidth_mobile", 0.6, 1.0))


def _whole(c: Column) -> Column:
    return c.cast("int")  # towards zero


def resize_plan(w: Column, h: Column) -> Column:
    """struct<scale, width, height>: shrunk so that the longest side fits, never enlarged."""
    longest = F.greatest(w, h)
    scale = F.when(longest > OCR_SIDE, F.lit(float(OCR_SIDE)) / longest).otherwise(F.lit(1.0))
    side = lambda x: F.when(longest > OCR_SIDE, F.greatest(F.lit(1), _whole(x * scale))).otherwise(x.cast("int"))
    return F.struct(scale.alias("scale"), side(w).alias("width"), side(h).alias("height"))


def capture_plan(w: Column, h: Column) -> Column:
    """struct<scale, width, height> of a camera frame, rounded half up."""
    scale = F.least(F.lit(1.0), F.lit(float(CAPTURE_SIDE)) / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5).cast("int"))
    return F.struct(scale.alias("scale"), side(w).alias("width"), side(h).alias("height"))


def roi_bbox(w: Column, h: Column, bottom: Column, left: Column) -> Column:
    """The bottom part of an image from its left side, as struct<x, y, w, h>."""
    y = F.greatest(F.lit(0), F.least(h - 1, _whole(h * (F.lit(1.0) - bottom))))
    x = F.greatest(F.lit(1), F.least(w, _whole(w * left)))
    return F.struct(F.lit(0).alias("x"), y.cast("int").alias("y"), x.cast("int").alias("w"), F.greatest(F.lit(1), h - y).cast("int").alias("h"))


def padded_bbox(bbox: Column, w: Column, h: Column, pad: float = PADDING) -> Column:
    """A box widened on each side by a share of its size, within the image; null stays null."""
    px, py = _whole(bbox["w"] * pad), _whole(bbox["h"] * pad)
    x1, y1 = F.greatest(F.lit(0), bbox["x"] - px), F.greatest(F.lit(0), bbox["y"] - py)
    x2, y2 = F.least(w, bbox["x"] + bbox["w"] + px), F.least(h, bbox["y"] + bbox["h"] + py)
    box = F.struct(x1.cast("int").alias("x"), y1.cast("int").alias("y"), F.greatest(F.lit(1), x2 - x1).cast("int").alias("w"), F.greatest(F.lit(1), y2 - y1).cast("int").alias("h"))
    return F.when(bbox.isNotNull(), box)


def normalize_quad(box: Column, inv_scale: Column, dx: Column, dy: Column) -> Column:
    """A polygon in the coordinates of the whole frame. Points of fewer than two numbers go; null gives no points."""
    points = F.filter(F.coalesce(box, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    return F.transform(points, lambda p: F.array(p[0] * inv_scale + dx, p[1] * inv_scale + dy))

"""Box geometry as columns. A box is a struct (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """A box of four columns."""
    as_col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(as_col(x1).alias("x1"), as_col(y1).alias("y1"), as_col(x2).alias("x2"), as_col(y2).alias("y2"))


def area(a: Column) -> Column:
    """Width x height; 0 for an empty box."""
    return F.greatest(a["x2"] - a["x1"], F.lit(0.0)) * F.greatest(a["y2"] - a["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Common area of two boxes."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(inner: Column, region: Column) -> Column:
    """Share of the inner box that lies in the region."""
    own = area(inner)
    return F.when(own > 0, intersection(inner, region) / own).otherwise(F.lit(0.0))


def proximity(a: Column, region: Column) -> Column:
    """1 - distance of the centres / diagonal of the region, 0 at least."""
    dx = (a["x1"] + a["x2"]) / 2 - (region["x1"] + region["x2"]) / 2
    dy = (a["y1"] + a["y2"]) / 2 - (region["y1"] + region["y2"]) / 2
    w, h = region["x2"] - region["x1"], region["y2"] - region["y1"]
    diagonal = F.sqrt(w * w + h * h)
    return F.when(diagonal > 0, F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / diagonal)).otherwise(F.lit(0.0))


def _band(p: Column, top: float, bottom: float) -> Column:
    h = p["y2"] - p["y1"]
    return F.struct(p["x1"].alias("x1"), (p["y1"] + h * top).alias("y1"), p["x2"].alias("x2"), (p["y1"] + h * bottom).alias("y2"))


def head_region(p: Column, bottom: float = 0.3) -> Column:
    """The top of a person box."""
    return _band(p, 0.0, bottom)


def torso_region(p: Column, top: float = 0.25, bottom: float = 0.75) -> Column:
    """The middle of a person box."""
    return _band(p, top, bottom)


def xyxy_to_cxcywh(a: Column, width: Column, height: Column) -> Column:
    """Pixel corners to centre and size as shares of the image."""
    return F.struct(((a["x1"] + a["x2"]) / 2 / width).alias("cx"), ((a["y1"] + a["y2"]) / 2 / height).alias("cy"), ((a["x2"] - a["x1"]) / width).alias("w"), ((a["y2"] - a["y1"]) / height).alias("h"))


def cxcywh_to_xyxy(c: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the image to pixel corners."""
    return F.struct(((c["cx"] - c["w"] / 2) * width).alias("x1"), ((c["cy"] - c["h"] / 2) * height).alias("y1"), ((c["cx"] + c["w"] / 2) * width).alias("x2"), ((c["cy"] + c["h"] / 2) * height).alias("y2"))


def clip_box(a: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the image."""
    x = lambda v: F.greatest(F.lit(0.0), F.least(v, width.cast("double")))
    y = lambda v: F.greatest(F.lit(0.0), F.least(v, height.cast("double")))
    return F.struct(x(a["x1"]).alias("x1"), y(a["y1"]).alias("y1"), x(a["x2"]).alias("x2"), y(a["y2"]).alias("y2"))

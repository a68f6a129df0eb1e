"""Checks and arithmetic of page regions and grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def valid_rect(rect: Column) -> Column:
    """Whether rect is [x, y, width, height], finite, inside the unit square but for the tolerance, and not empty."""
    number = F.forall(rect, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda i: F.element_at(rect, i)
    inside = (at(1) >= -TOLERANCE) & (at(2) >= -TOLERANCE) & (at(3) > 0) & (at(4) > 0) & (at(1) + at(3) <= 1 + TOLERANCE) & (at(2) + at(4) <= 1 + TOLERANCE)
    return F.coalesce((F.size(rect) == 4) & number & F.when(F.size(rect) == 4, inside), F.lit(False))


def rotation(x: Column) -> Column:
    """A quarter turn in 0..270, null for any other angle."""
    turned = F.pmod(x.cast("int"), F.lit(360))
    return F.when(turned.isin(0, 90, 180, 270), turned)


def valid_cuts(cuts: Column) -> Column:
    """Whether grid cuts start at 0, end at 1 and increase strictly."""
    steps = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda a, b: b > a)
    ends = (F.abs(F.element_at(cuts, 1)) <= TOLERANCE) & (F.abs(F.element_at(cuts, -1) - 1) <= TOLERANCE)
    return F.coalesce(F.when(F.size(cuts) >= 2, ends & F.forall(steps, lambda ok: ok)), F.lit(False))


def letterbox(width: Column, height: Column, side: int) -> Column:
    """Size of a picture fitted into a square, and its margins."""
    scale = F.least(side / width, side / height)
    w, h = F.greatest(F.lit(1), F.bround(width * scale)).cast("int"), F.greatest(F.lit(1), F.bround(height * scale)).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((side - w) / 2).cast("int").alias("left"), F.floor((side - h) / 2).cast("int").alias("top"))


def unletterbox(box: Column, width: Column, height: Column) -> Column:
    """How a picture comes back out of a square: the part to cut out, and the factors that bring it to its size."""
    part = F.struct(box["left"].alias("left"), box["top"].alias("top"), (box["left"] + box["width"]).alias("right"), (box["top"] + box["height"]).alias("bottom"))
    return F.struct(part.alias("part"), (width / box["width"]).alias("x_factor"), (height / box["height"]).alias("y_factor"))


def centred(centre: Column, length: Column, limit: Column) -> Column:
    """Start and end of a stretch of a length about a centre, moved and cut to lie within 0 and the limit."""
    held = F.least(F.greatest(F.lit(1), length), limit)
    start = F.least(F.greatest(F.lit(0), F.bround(centre - held / 2).cast("int")), limit - held)
    return F.struct(start.alias("start"), (start + held).alias("end"))


def crop_box(mask: Column, width: Column, height: Column, padding: float) -> Column:
    """left, top, right, bottom of a square about the box of a mask with padding on all sides, as far as the picture allows;
    null for a mask without a box."""
    w, h = mask["right"] - mask["left"], mask["bottom"] - mask["top"]
    side = F.bround(F.greatest(w, h) * (1 + 2 * padding)).cast("int")
    x = centred((mask["left"] + mask["right"]) / 2, F.least(width, F.greatest(w, side)), width)
    y = centred((mask["top"] + mask["bottom"]) / 2, F.least(height, F.greatest(h, side)), height)
    return F.when(mask.isNotNull(), F.struct(x["start"].alias("left"), y["start"].alias("top"), x["end"].alias("right"), y["end"].alias("bottom")))


def clamped(x: Column, low, high) -> Column:
    """x brought into a range."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))

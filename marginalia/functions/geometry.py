"""Boxes on pages, in points with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_HEIGHT = 842.0  #: where a page does not say
PAD, BOX_PAD, TARGET_WIDTH = 6.0, 2.0, 2400.0
UNION_PAD_X, UNION_PAD_Y = 40.0, 14.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def to_top_left(left: Column, top: Column, right: Column, bottom: Column, origin: Column, page_height: Column) -> Column:
    """A layout box with its origin at the top left, two decimals."""
    height = F.coalesce(page_height, F.lit(PAGE_HEIGHT))
    below = F.contains(F.upper(F.coalesce(origin, F.lit(""))), F.lit("BOTTOM"))
    a, b = F.when(below, height - top).otherwise(top), F.when(below, height - bottom).otherwise(bottom)
    return box(F.round(left, 2), F.round(F.least(a, b), 2), F.round(right, 2), F.round(F.greatest(a, b), 2))


def padded(region: Column, width: Column, height: Column) -> Column:
    """A region with some context, inside its page."""
    return box(
        F.greatest(region["x0"] - PAD, F.lit(0.0)),
        F.greatest(region["y0"] - PAD, F.lit(0.0)),
        F.least(region["x1"] + PAD, width),
        F.least(region["y1"] + PAD, height),
    )


def zoom(region: Column) -> Column:
    return F.least(F.lit(8.0), F.greatest(F.lit(2.0), F.lit(TARGET_WIDTH) / F.greatest(region["x1"] - region["x0"], F.lit(1.0))))


def pixels(hit: Column, region: Column, scale: Column) -> Column:
    """A hit's outline in the pixels of a rendered region."""
    return box(
        (hit["x0"] - BOX_PAD - region["x0"]) * scale,
        (hit["y0"] - BOX_PAD - region["y0"]) * scale,
        (hit["x1"] + BOX_PAD - region["x0"]) * scale,
        (hit["y1"] + BOX_PAD - region["y0"]) * scale,
    )


def crop_name(claim_id: Column, slug: Column, page: Column) -> Column:
    return F.format_string("claim_%02d_%s_p%d.png", claim_id, slug, page)

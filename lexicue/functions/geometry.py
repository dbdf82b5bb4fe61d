"""Boxes and layout: polygons to boxes, character boxes, caption layout, screen fit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexicue import constants as K
from lexicue.functions import text as T


def polygon_box(points: Column, scale: float = 1.0) -> Column:
    """Axis-aligned box ``struct<x0,y0,x1,y1>`` of ``array<struct<x,y>>``; ``scale`` undoes resizing."""
    xs = F.transform(points, lambda p: p["x"] * scale)
    ys = F.transform(points, lambda p: p["y"] * scale)
    return F.struct(
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )


def rounded(c: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.bround(c, 0).cast("int")


def box_struct(box: Column) -> Column:
    return F.struct(
        rounded(box["x0"]).alias("x"),
        rounded(box["y0"]).alias("y"),
        rounded(box["x1"] - box["x0"]).alias("width"),
        rounded(box["y1"] - box["y0"]).alias("height"),
    )


def equal_char_boxes(text: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """One box of equal width per character."""
    step = width / F.greatest(F.length(text), F.lit(1))
    return F.transform(
        T.chars(text),
        lambda ch, i: F.struct(
            ch.alias("char"),
            rounded(x + i * step).alias("x"),
            rounded(y).alias("y"),
            rounded(step).alias("width"),
            rounded(height).alias("height"),
        ),
    )


def unit_boxes(
    text: Column, x: Column, y: Column, char_width: Column, height: Column, wide_run_stop: bool = True
) -> Column:
    """One box per CJK character or run of other characters, placed by its start offset."""
    return F.transform(
        T.script_units(text, wide_run_stop),
        lambda u: F.struct(
            u["unit"].alias("char"),
            rounded(x + u["start"] * char_width).alias("x"),
            rounded(y).alias("y"),
            rounded(F.length(u["unit"]) * char_width).alias("width"),
            rounded(height).alias("height"),
        ),
    )


def caption_layout(text: Column, width: Column, height: Column) -> Column:
    """Centred caption near the bottom edge, whole pixels: ``struct<x,y,width,height,char_width>``."""
    n = F.length(text)
    usable = (width * K.LAYOUT_WIDTH).cast("int")
    char_width = F.least(
        F.floor(usable / F.greatest(n, F.lit(1))).cast("int"), (width * K.LAYOUT_CHAR_WIDTH).cast("int")
    )
    total = char_width * n
    return F.struct(
        F.floor((width - total) / 2).cast("int").alias("x"),
        (height * K.LAYOUT_TOP).cast("int").alias("y"),
        total.alias("width"),
        (height * K.LAYOUT_HEIGHT).cast("int").alias("height"),
        char_width.alias("char_width"),
    )


def contain_fit(vw: Column, vh: Column, cw: Column, ch: Column) -> Column:
    """Scale and offsets that fit a source picture inside a container without cropping."""
    wider = vw / vh > cw / ch
    scale = F.when(wider, cw / vw).otherwise(ch / vh)
    zero = F.lit(0.0)
    return F.struct(
        scale.alias("scale"),
        F.when(wider, zero).otherwise((cw - vw * scale) / 2).alias("offset_x"),
        F.when(wider, (ch - vh * scale) / 2).otherwise(zero).alias("offset_y"),
    )


def span_centre(first_x: Column, last_x: Column, last_width: Column) -> Column:
    return (first_x + last_x + last_width) / 2


def frame_height_estimate(detections: Column) -> Column:
    """10 % below the lowest box, at least the usual portrait height."""
    lowest = F.array_max(F.transform(detections, lambda d: d["bbox"]["y"] + d["bbox"]["height"]))
    return F.greatest(lowest * 1.1, F.lit(float(K.MIN_FRAME_HEIGHT)))


def by_y_desc(detections: Column) -> Column:
    """Detections from the lowest on screen upwards; equal heights keep their order."""
    indexed = F.transform(
        detections, lambda d, i: F.struct((-d["bbox"]["y"]).alias("k"), i.alias("i"), d.alias("d"))
    )
    return F.transform(F.array_sort(indexed), lambda s: s["d"])


def joined_text(detections: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(detections, lambda d: d["text"]), sep)


def caption_text(detections: Column) -> Column:
    """Text used to compare frames: the lower part of the frame, or everything if that is empty."""
    height = frame_height_estimate(detections)
    ordered = by_y_desc(detections)
    lower = joined_text(F.filter(ordered, lambda d: d["bbox"]["y"] / height > K.CAPTION_AREA))
    return F.when(lower != "", lower).otherwise(joined_text(ordered))


def lower_text(detections: Column) -> Column:
    """Text below the fixed line used when flicker is merged."""
    return joined_text(F.filter(detections, lambda d: d["bbox"]["y"] > K.CAPTION_MIN_Y))

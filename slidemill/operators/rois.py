"""Regions of interest: providers, their union, and subdivision. Rows: slide_ord, roi_index, x, y, w, h and the slide's sw, sh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked(rois: DataFrame) -> DataFrame:
    """Boxes, with an error for any that reaches outside its slide; boxes are never clipped."""
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("sw")) | (F.col("y") + F.col("h") > F.col("sh"))
    text = F.concat_ws(" ", F.lit("region"), *[F.col(c).cast("string") for c in ("x", "y", "w", "h")], F.lit("lies outside slide"), F.col("slide_ord").cast("string"))
    return rois.withColumn("x", F.when(out, F.raise_error(text).cast("long")).otherwise(F.col("x")))


def rect_rois(slides: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes(wsi_id, ord, x, y, w, h) of the slides(slide_ord, wsi_id, w, h) with that id; ids without a slide give none."""
    s = slides.select("slide_ord", "wsi_id", F.col("w").alias("sw"), F.col("h").alias("sh"))
    return checked(s.join(boxes, "wsi_id").select("slide_ord", "sw", "sh", F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")]))


def whole_slides(slides: DataFrame) -> DataFrame:
    return slides.select("slide_ord", F.col("w").alias("sw"), F.col("h").alias("sh"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "w", "h")


def attach_rois(slides: DataFrame, providers: list[DataFrame], on_empty: str = "error") -> DataFrame:
    """All providers' boxes in their order, numbered by roi_index; slides with none fail the query, or are one region with on_empty="whole_slide"."""
    if on_empty not in ("error", "whole_slide"):
        raise ValueError("on_empty must be 'error' or 'whole_slide'")
    named = [p.select("slide_ord", "sw", "sh", F.lit(i).alias("provider"), "ord", "x", "y", "w", "h") for i, p in enumerate(providers)]
    got = reduce(DataFrame.unionByName, named)
    empty = slides.join(got.select("slide_ord").distinct(), "slide_ord", "left_anti")
    rest = whole_slides(empty).withColumn("provider", F.lit(len(providers)))
    if on_empty == "error":
        rest = rest.withColumn("x", F.raise_error(F.concat(F.lit("no region for slide "), F.col("slide_ord").cast("string"))).cast("long"))
    order = Window.partitionBy("slide_ord").orderBy("provider", "ord")
    return got.unionByName(rest).withColumn("roi_index", (F.row_number().over(order) - 1).cast("long")).drop("provider", "ord")


def contains_point(x, y):
    """Half-open box test on the row's region."""
    return (x >= F.col("rx")) & (x < F.col("rx") + F.col("rw")) & (y >= F.col("ry")) & (y < F.col("ry") + F.col("rh"))


def contains_patch(x, y, size: int):
    """All four corner pixels of the patch are in the region."""
    return contains_point(x, y) & contains_point(x + (size - 1), y + (size - 1)) & contains_point(x, y + (size - 1)) & contains_point(x + (size - 1), y)


def intersects_patch(x, y, size: int):
    """Any of the four corner pixels is in the region; a region strictly inside the patch is missed."""
    return contains_point(x, y) | contains_point(x + (size - 1), y + (size - 1)) | contains_point(x, y + (size - 1)) | contains_point(x + (size - 1), y)


def subdivide(rois: DataFrame, max_size: int, tile_size: int, stride: int) -> DataFrame:
    """Boxes in parts of at most max_size, whose sides are floored to the stride; parts smaller than a tile go."""
    step = F.lit(max_size).cast("long")
    along = lambda c, n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - 1, F.lit(0)), step))
    parts = rois.filter("w > 0 and h > 0").withColumn("oy", along("y", "h")).withColumn("ox", along("x", "w"))
    side = lambda n, o: F.floor(F.least(step, F.col(n) - F.col(o)) / stride) * stride
    parts = parts.select("slide_ord", "roi_index", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), side("w", "ox").alias("w"), side("h", "oy").alias("h"))
    return parts.filter((F.col("w") >= tile_size) & (F.col("h") >= tile_size))

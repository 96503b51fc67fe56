"""Tile grids, read windows, edge policies and batches: plain Catalyst plans."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
MODES = ("any_overlap", "full_inside_bounds", "center_in_roi")
EDGES = ("drop", "zeros", "edge")
ROI_EDGES = ("clip", "read_from_image")
KEY = ["slide_ord", "roi_index"]
#: Slides whose tiles one task makes.
SLIDES = 5000


def dealt(rois: DataFrame, slides: int, each: int = SLIDES) -> DataFrame:
    """Regions by slide, in tasks of about so many slides each of their number `slides`. A region is a short row that many tiles are made of: adaptive execution, which merges partitions by bytes, would leave all to a few tasks."""
    return rois.repartition(max(rois.sparkSession.sparkContext.defaultParallelism, -(-slides // each)), "slide_ord")


def axis(start: Column, end: Column, tile_size: int, stride: int) -> Column:
    """Tile origins along one axis: one if the length is within a tile, else every stride while a new tile adds pixels."""
    last = F.greatest(start, end - max(0, tile_size - stride) - 1)
    return F.when(end - start <= tile_size, F.array(start)).otherwise(F.sequence(start, last, F.lit(stride).cast("long")))


def plan_tiles(rois: DataFrame, tile_size: int, stride: int, mode: str = "any_overlap", accept: Callable[[Column, Column], Column] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """slide_ord, roi_index, tile_ord, x, y with the region bx, by, bw, bh, its clamped ends and the slide's sw, sh.

    Order is by rows of tiles. any_overlap keeps the whole grid, the others test against the unclamped box.
    accept, for regions of other shapes, says of a tile's x and y if it stays; carry: columns of the regions that it needs.
    """
    if tile_size <= 0 or stride <= 0:
        raise ValueError("tile_size and stride must be positive")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if stride > tile_size:
        log.warning("stride %s is larger than tile_size %s: pixels between tiles are skipped", stride, tile_size)
    r = rois.select(*KEY, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"), "sw", "sh", *carry)
    r = r.withColumns({"x_end": F.least(F.col("bx") + F.col("bw"), "sw"), "y_end": F.least(F.col("by") + F.col("bh"), "sh")})
    g = r.select("*", F.posexplode(axis(F.col("by"), F.col("y_end"), tile_size, stride)).alias("iy", "y"))
    nx = F.size(axis(F.col("bx"), F.col("x_end"), tile_size, stride))
    g = g.withColumn("nx", nx).select("*", F.posexplode(axis(F.col("bx"), F.col("x_end"), tile_size, stride)).alias("ix", "x"))
    g = g.withColumn("tile_ord", (F.col("iy") * F.col("nx") + F.col("ix")).cast("long")).drop("iy", "ix", "nx")
    if mode == "full_inside_bounds":
        g = g.filter((F.col("x") + tile_size <= F.col("bx") + F.col("bw")) & (F.col("y") + tile_size <= F.col("by") + F.col("bh")))
    elif mode == "center_in_roi":
        g = g.filter((F.col("x") + tile_size / 2 < F.col("bx") + F.col("bw")) & (F.col("y") + tile_size / 2 < F.col("by") + F.col("bh")))
    return g if accept is None else g.filter(accept(F.col("x"), F.col("y"))).drop(*carry)


def grid_tiles_at(regions: DataFrame, tile_size: int) -> DataFrame:
    """x, y of the tiles of the whole slide's grid, stride tile_size, that each of regions(slide_ord, roi_index, rx, ry, rw, rh, sw, sh) touches; a region without width or height touches what a pixel would.

    Tiles of such a grid are its cells, so a region's are told from its box, and the others are never made.
    """
    cells = lambda at, side: F.explode(F.sequence(F.floor(F.col(at) / tile_size), F.floor((F.col(at) + F.greatest(F.col(side), F.lit(1)) - 1) / tile_size)))
    t = regions.select("*", cells("rx", "rw").alias("x")).select("*", cells("ry", "rh").alias("y")).withColumns({c: F.col(c) * tile_size for c in "xy"})
    on_slide = lambda c, s: (F.col(c) >= 0) & (F.col(c) < F.greatest(F.col(s), F.lit(1)))
    return t.filter(on_slide("x", "sw") & on_slide("y", "sh"))


def window_size(stride: int, max_window_size: int | None = None) -> int:
    if max_window_size is None:
        if stride > 5000:
            raise ValueError("stride over 5000 needs a max_window_size")
        return 5000 // stride * stride
    if max_window_size <= 0 or max_window_size % stride:
        raise ValueError("max_window_size must be a positive multiple of the stride")
    return max_window_size


def with_windows(tiles: DataFrame, tile_size: int, stride: int, max_window_size: int | None = None) -> DataFrame:
    """Tiles with win_key and the window's read box rx, ry, rw, rh, clamped to region and slide."""
    m = window_size(stride, max_window_size)
    n = lambda b, e: F.greatest(F.lit(1).cast("long"), F.ceil((F.col(e) - F.col(b)) / m))
    at = lambda c, b, e: F.least(F.greatest(F.floor((F.col(c) - F.col(b)) / m), F.lit(0).cast("long")), n(b, e) - 1)
    t = tiles.withColumns({"wx": at("x", "bx", "x_end"), "wy": at("y", "by", "y_end")})
    t = t.withColumns({"win_key": F.col("wy") * n("bx", "x_end") + F.col("wx"), "rx": F.col("bx") + F.col("wx") * m, "ry": F.col("by") + F.col("wy") * m})
    side = lambda o, e: F.least(F.least(F.lit(m).cast("long"), F.col(e) - F.col(o)) + max(0, tile_size - stride), F.col(e) - F.col(o))
    return t.withColumns({"rw": side("rx", "x_end"), "rh": side("ry", "y_end")}).drop("wx", "wy")


def grown(windowed: DataFrame, tile_size: int) -> DataFrame:
    """Read boxes grown to the ends of their tiles, within the slide (the policy "read_from_image")."""
    own = Window.partitionBy(*KEY, "win_key")
    grow = lambda c, o, n, s: F.greatest(F.col(n), F.least(F.max(c).over(own) - F.col(o) + tile_size, F.col(s) - F.col(o)))
    return windowed.withColumns({"rw": grow("x", "rx", "rw", "sw"), "rh": grow("y", "ry", "rh", "sh")})


def read_windows(windowed: DataFrame, grow: int | None = None) -> DataFrame:
    """One row for each window: its read box and the number of its tiles. grow: a tile size, by which boxes are grown as grown() does, but from the window's ends alone: no tile is sorted."""
    ends = [] if grow is None else [F.max("x").alias("x"), F.max("y").alias("y"), F.first("sw").alias("sw"), F.first("sh").alias("sh")]
    out = windowed.groupBy(*KEY, "win_key").agg(*[F.first(c).alias(c) for c in ("rx", "ry", "rw", "rh")], F.count("*").alias("n_tiles"), *ends)
    if grow is None:
        return out
    reach = lambda c, o, n, s: F.greatest(F.col(n), F.least(F.col(c) - F.col(o) + grow, F.col(s) - F.col(o)))
    return out.withColumns({"rw": reach("x", "rx", "rw", "sw"), "rh": reach("y", "ry", "rh", "sh")}).drop("x", "y", "sw", "sh")


def with_padding(windowed: DataFrame, tile_size: int, policy: str = "drop") -> DataFrame:
    """pad_w, pad_h: what a tile lacks of its size in its read box. The policy "drop" drops tiles that lack any, before anything is read."""
    if policy not in EDGES:
        raise ValueError(f"unknown edge policy {policy!r}; one of {EDGES}")
    lack = lambda c, o, n: tile_size - F.least(F.lit(tile_size).cast("long"), F.col(n) - (F.col(c) - F.col(o)))
    out = windowed.withColumns({"pad_w": lack("x", "rx", "rw"), "pad_h": lack("y", "ry", "rh")})
    return out.filter("pad_w = 0 and pad_h = 0") if policy == "drop" else out


def level0_origin(windowed: DataFrame) -> DataFrame:
    """Read boxes in level-0 pixels, rounded half even, and their size before resampling: needs downsample and resample_factor."""
    r = lambda c, f: F.bround(F.col(c) * F.col(f), 0).cast("long")
    return windowed.withColumns({"x0": r("rx", "downsample"), "y0": r("ry", "downsample"), "read_w": r("rw", "resample_factor"), "read_h": r("rh", "resample_factor")})


def with_batches(windowed: DataFrame, batch_size: int = 200) -> DataFrame:
    """batch_ord: number of the batch within the slide; batches never reach across windows."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    rn = F.row_number().over(Window.partitionBy(*KEY, "win_key").orderBy("tile_ord"))
    # batches begun so far; the order is that of the windows' tiles, so tiles are sorted once
    so_far = Window.partitionBy("slide_ord").orderBy("roi_index", "win_key", "tile_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = windowed.withColumn("starts", ((rn - 1) % batch_size == 0).cast("long"))
    return t.withColumn("batch_ord", F.sum("starts").over(so_far) - 1).drop("starts")


def with_edge_distance(tiles: DataFrame, tile_size: int) -> DataFrame:
    """edge_distance: whole tiles between a tile and the nearest slide edge."""
    up = lambda s, c: -F.floor(-(F.col(s) - F.col(c)) / tile_size) - 1
    return tiles.withColumn("edge_distance", F.least(F.floor(F.col("x") / tile_size), F.floor(F.col("y") / tile_size), up("sw", "x"), up("sh", "y")))


def remove_edge_tiles(tiles: DataFrame, tile_size: int, depth: int = 1) -> DataFrame:
    """Tiles at least `depth` tiles from each edge; depth 0 only measures. Geometry alone, so it stands before any pixel is read."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    return with_edge_distance(tiles, tile_size).filter(F.col("edge_distance") >= depth)

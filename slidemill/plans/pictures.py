"""Thumbnails of slides, and the outlines of chosen patches on them, as PNG files: a task for each slide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.functions import pixels, png
from slidemill.sources.files import opened
from slidemill.sources.tiff import levels_at, read_window

SCHEMA = "slide_ord int, wsi_id string, png binary, w int, h int"


def read_thumbnail(path: str, most: int) -> np.ndarray:
    """(h, w, 3) with the longer side at most `most`: the smallest level that is as large, or the largest, shrunk by areas.

    The level is read in bands, so a slide without small levels needs no more memory than one with them.
    """
    with opened(path) as f:
        all_ = levels_at(path, f)
        level = next((v for v in reversed(all_) if max(v.w, v.h) >= most), all_[0])
        scale = min(1.0, most / max(level.w, level.h))
        w, h = max(1, round(level.w * scale)), max(1, round(level.h * scale))
        rows = max(1, min(h, int(16_000_000 * scale / level.w)))
        bands = []
        for y in range(0, h, rows):
            top, end = round(y * level.h / h), round(min(h, y + rows) * level.h / h)
            part = read_window(f, level, 0, top, level.w, max(1, end - top), 4 if level.channels == 4 else 3)
            part = on_white(part) if part.shape[2] == 4 else part
            n = min(h, y + rows) - y
            bands.append(part if part.shape[:2] == (n, w) else pixels.resize(part, n, w, "area"))
    return np.concatenate(bands)


def on_white(px: np.ndarray) -> np.ndarray:
    """(h, w, 3) of (h, w, 4): what is clear shows white."""
    a = px[..., 3:].astype(np.float32) / 255
    return np.rint(px[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def thumbnails(slides: DataFrame, most: int = 1024) -> DataFrame:
    """slide_ord, wsi_id, png, w, h for each row of slides(slide_ord, wsi_id, wsi_path)."""
    if most < 1:
        raise ValueError("most must be positive")

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                image = read_thumbnail(r.wsi_path, most)
                yield pd.DataFrame([(r.slide_ord, r.wsi_id, png.encode(image), image.shape[1], image.shape[0])], columns=["slide_ord", "wsi_id", "png", "w", "h"])

    return slides.select("slide_ord", "wsi_id", "wsi_path").mapInPandas(run, SCHEMA)


def selected_patches(patches: DataFrame, slides: DataFrame, tile_size: int, most: int = 1024, colour: tuple[int, int, int] = (220, 30, 30), stride: int | None = None, paste: bool = False, opacity: float = 1.0) -> DataFrame:
    """The thumbnails of slides(slide_ord, wsi_id, wsi_path, w, h) with the outlines of patches(slide_ord, x, y), and with paste their own pixels, as they are after all stages.

    Corners are first moved back to the grid of the stride, where one is given. Patches that reach beyond the slide are left out. Patches
    are reduced to the distinct places of their corners on the thumbnail, and pasted ones to their size there, before
    a slide's rows meet, so a slide's group has most x most rows at most, whatever the number of its patches. Of several pasted at one
    place one shows. opacity: of the outlines.
    """
    if most < 1 or tile_size < 1 or (stride is not None and stride < 1):
        raise ValueError("most, tile_size and stride must be positive")
    shrink = F.least(F.lit(1.0), most / F.greatest("w", "h"))
    at = lambda c: F.bround(F.col(c) * F.col("shrink"), 0).cast("int")
    own = slides.select("slide_ord", "w", "h", shrink.alias("shrink"))
    marks = patches.select("slide_ord", *[(F.floor(F.col(c) / stride) * stride if stride else F.col(c)).alias(c) for c in "xy"], *(["pixels", "ph", "pw", "pc"] if paste else []))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + tile_size <= F.col("w")) & (F.col("y") + tile_size <= F.col("h"))
    side = F.greatest(F.lit(1), F.bround(tile_size * F.col("shrink"), 0)).cast("int")
    marks = marks.join(own, "slide_ord").filter(inside).withColumns({"mx": at("x"), "my": at("y"), "side": side})

    @F.pandas_udf("binary")
    def shrunk(px: pd.Series, ph: pd.Series, pw: pd.Series, pc: pd.Series, side: pd.Series) -> pd.Series:
        out = []
        for p, h, w, c, s in zip(px, ph, pw, pc, side, strict=True):
            image = np.frombuffer(p, np.uint8).reshape(h, w, c)
            image = on_white(image) if c == 4 else np.repeat(image, 3, axis=2) if c == 1 else image
            out.append((image if (h, w) == (s, s) else pixels.resize(np.ascontiguousarray(image), s, s, "area" if s < min(h, w) else "bilinear")).tobytes())
        return pd.Series(out, dtype=object)

    place = ["slide_ord", "mx", "my", "side"]
    if paste:
        marks = marks.withColumn("small", shrunk("pixels", "ph", "pw", "pc", "side")).groupBy(*place).agg(F.min_by("small", F.struct("y", "x")).alias("small"))
    else:
        marks = marks.select(*place).distinct().withColumn("small", F.lit(None).cast("binary"))

    def draw(key: tuple, slide: pd.DataFrame, corners: pd.DataFrame) -> pd.DataFrame:
        if not len(slide):
            return pd.DataFrame(columns=["slide_ord", "wsi_id", "png", "w", "h"])
        image = read_thumbnail(slide["wsi_path"].iloc[0], most)
        h, w, _ = image.shape
        corners = corners.sort_values(["my", "mx"])
        for x, y, side, small in zip(corners["mx"], corners["my"], corners["side"], corners["small"], strict=True) if paste else ():
            part = np.frombuffer(small, np.uint8).reshape(side, side, 3)[: max(0, h - y), : max(0, w - x)]
            image[y : y + part.shape[0], x : x + part.shape[1]] = part
        line = np.zeros((h, w), bool)
        for x, y, side in zip(corners["mx"], corners["my"], corners["side"], strict=True):
            right, low = min(w - 1, x + side - 1), min(h - 1, y + side - 1)
            if x <= right and y <= low:
                line[[y, low], x : right + 1] = True
                line[y : low + 1, [x, right]] = True
        image[line] = np.rint(image[line] * (1 - opacity) + np.array(colour) * opacity)
        return pd.DataFrame([(key[0], slide["wsi_id"].iloc[0], png.encode(image), w, h)], columns=["slide_ord", "wsi_id", "png", "w", "h"])

    return slides.select("slide_ord", "wsi_id", "wsi_path").groupBy("slide_ord").cogroup(marks.groupBy("slide_ord")).applyInPandas(draw, SCHEMA)

"""Spatial annotation of tiles: points by a bucket equi-join with a range test, features by their centroid."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a bucket beyond which it is crowded: its points are dealt in parts of about so many, and only its tiles copied to each part.
CROWD = 20_000
#: Crowded buckets up to which they are joined by broadcast.
BROADCAST = 100_000
#: What tells tiles apart.
TILE = ["slide_ord", "roi_index", "x", "y"]


def _along(c: str, lo: int, hi: int, tile_size: int):
    return F.explode(F.sequence(F.floor((F.col(c) + lo) / tile_size), F.floor((F.col(c) + hi) / tile_size)))


def bucketed(tiles: DataFrame, points: DataFrame, tile_size: int, copy: str = "tiles", crowd: int = CROWD) -> tuple[DataFrame, DataFrame, list[str]]:
    """Tiles and points with the keys of the buckets of tile_size in which they can meet.

    A tile covers one to four buckets, so one side is copied: the tiles, or with copy="points" the points. Points are
    counted by slide first, and those of slides that could have a crowded bucket by bucket; where none is crowded nothing else is copied.
    """
    if copy not in ("tiles", "points"):
        raise ValueError("copy must be 'tiles' or 'points'")
    whole = lambda df, x, y: df.withColumns({"gx": F.floor(F.col(x) / tile_size), "gy": F.floor(F.col(y) / tile_size)})
    if copy == "tiles":
        t = tiles.withColumn("gx", _along("x", 0, tile_size - 1, tile_size)).withColumn("gy", _along("y", 0, tile_size - 1, tile_size))
        p = whole(points, "px", "py")
    else:
        t = whole(tiles, "x", "y")
        p = points.withColumn("gx", _along("px", -tile_size, 0, tile_size)).withColumn("gy", _along("py", -tile_size, 0, tile_size))
    key = ["slide_ord", "gx", "gy"]
    many = points.groupBy("slide_ord").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("slide_ord")
    if not (n := many.count()):
        return t, p, key
    many = F.broadcast(many) if n <= BROADCAST else many
    crowded = p.join(many, "slide_ord", "left_semi").groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*key, F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    if not (n := crowded.count()):
        return t, p, key
    crowded = F.broadcast(crowded) if n <= BROADCAST else crowded.hint("merge")
    parts = F.coalesce("parts", F.lit(1))
    p = p.withColumn("dealt_by", F.xxhash64(*points.columns)).join(crowded, key, "left").withColumn("part", F.pmod("dealt_by", parts).cast("int")).drop("parts", "dealt_by")
    t = t.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return t, p, [*key, "part"]


def points_in_tiles(tiles: DataFrame, points: DataFrame, tile_size: int, copy: str = "tiles", crowd: int = CROWD) -> DataFrame:
    """Tiles(slide_ord, roi_index, x, y) and the points(slide_ord, px, py, ...) in them, half open, with local lx, ly. A point may fall in several tiles.

    Both sides are shuffled by bucket: what is exploded is larger than the optimizer can know, so it never goes by broadcast. copy: the side to copy, the smaller one.
    """
    return _met(*bucketed(tiles.select(*TILE), points, tile_size, copy, crowd), tile_size).drop("gx", "gy", "part")


def _met(t: DataFrame, p: DataFrame, key: list[str], tile_size: int, how: str = "inner") -> DataFrame:
    """Bucketed tiles and the points in them; with how="left" also tiles without any."""
    within = lambda c: (F.col(f"p.p{c}") >= F.col(f"t.{c}")) & (F.col(f"p.p{c}") < F.col(f"t.{c}") + tile_size)
    same = [F.col(f"t.{c}") == F.col(f"p.{c}") for c in key]
    j = t.hint("merge").alias("t").join(p.alias("p"), reduce(lambda a, b: a & b, [*same, within("x"), within("y")]), how)
    j = j.select(*[F.col(f"t.{c}") for c in t.columns], *[F.col(f"p.`{c}`") for c in p.columns if c not in key])
    return j.withColumns({"lx": (F.col("px") - F.col("x")).cast("int"), "ly": (F.col("py") - F.col("y")).cast("int")})


def annotate_points(tiles: DataFrame, points: DataFrame, tile_size: int, column: str = "annotations", filter_empty: bool = False, copy: str = "tiles", crowd: int = CROWD) -> DataFrame:
    """Tiles with an array of (x, y, label) of their points, in local pixels; without any an empty one, or no row with filter_empty."""
    t, p, key = bucketed(tiles.select(*TILE), points, tile_size, copy, crowd)
    # a tile that isn't copied has one bucket: its points are there already, and no second shuffle gathers them
    here = ["gx", "gy"] if copy == "points" and "part" not in key else []
    bare = set(tiles.columns) == set(TILE)
    note = F.when(F.col("px").isNotNull(), F.struct(F.col("lx").alias("x"), F.col("ly").alias("y"), F.col("label").cast("int").alias("label")))
    found = _met(t, p, key, tile_size, "left" if bare and not filter_empty else "inner").groupBy(*TILE, *here).agg(F.array_sort(F.collect_list(note)).alias(column)).drop(*here)
    out = found.select(*tiles.columns, column) if bare else tiles.join(found, TILE, "inner" if filter_empty else "left")
    return out.withColumn(column, F.coalesce(column, F.array().cast("array<struct<x:int,y:int,label:int>>")))


def centroids(vertices: DataFrame, scale: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """slide_ord, fid, px, py: (mean of all vertices vx, vy + offset) * scale, closing vertices and inner rings included; features without any give none."""
    v = vertices.filter("vx is not null and vy is not null")
    at = lambda c, o: (F.avg(c) + o) * scale
    return v.groupBy("slide_ord", "fid").agg(at("vx", offset_x).alias("px"), at("vy", offset_y).alias("py"), *[F.first(c).alias(c) for c in carry])


def shift_vertex(v, origin, scale: float = 1.0, offset: float = 0.0):
    """A vertex coordinate in a tile's pixels, rounded half even."""
    return F.bround(v * scale - (origin - offset * scale), 0).cast("long")


def annotate_features(tiles: DataFrame, features: DataFrame, tile_size: int, property_keys: Sequence[str] | None = None, geometry: bool = False, geometry_key: str = "geometry", column: str = "annotations", filter_empty: bool = False, copy: str = "tiles", crowd: int = CROWD) -> DataFrame:
    """Tiles with an array of JSON objects, in order of fid, of the features whose centroid is in them; without any an empty one, or no row with filter_empty.

    An object has the feature's properties, or those of property_keys (null where it lacks one), and with geometry its
    shape under geometry_key, in the tile's pixels. features as geojson_cells gives them.
    """
    from slidemill.sources.annotations import shifted

    @F.pandas_udf("string")
    def cell(properties: pd.Series, shape: pd.Series, scale: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        out = []
        for p, g, k, a, b in zip(properties, shape, scale, dx, dy, strict=True):
            own = json.loads(p) if p else {}
            own = own if property_keys is None else {key: own.get(key) for key in property_keys}
            if geometry:
                g = json.loads(g) if g else {}
                own[geometry_key] = {"type": g.get("type"), "coordinates": shifted(g.get("coordinates"), k, a, b)}
            out.append(json.dumps(own, sort_keys=True))
        return pd.Series(out, dtype=object)

    met = points_in_tiles(tiles, features.filter("px is not null"), tile_size, copy, crowd)
    met = met.withColumn("cell", cell("properties", "geometry", "scale", F.col("x") - F.col("ox") * F.col("scale"), F.col("y") - F.col("oy") * F.col("scale")))
    found = met.groupBy(*TILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "cell"))), lambda c: c["cell"]).alias(column))
    out = tiles.join(found, TILE, "inner" if filter_empty else "left")
    return out.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))

"""Readers of region XML, point CSV and GeoJSON files as DataFrames."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidemill.sources.files import opened
from slidemill.sources.held import hold

XML = "`_PartOfGroup` string, `_Type` string, Coordinates struct<Coordinate:array<struct<`_X`:double,`_Y`:double>>>"


def _qualified(spark: SparkSession, path: str) -> str:
    """The full name of a file, as Spark's readers give it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()


def _with_files(spark: SparkSession, files: dict[str, str], slides: DataFrame) -> DataFrame:
    """Slides with path, the full name of each one's file as _metadata.file_path gives it; a slide without a file fails the query."""
    held = [(wsi_id, _qualified(spark, path)) for wsi_id, path in files.items()]
    lacks = F.raise_error(F.concat(F.lit("no annotation file for slide "), "wsi_id")).cast("string")
    s = slides.join(spark.createDataFrame(held, "wsi_id string, path string"), "wsi_id", "left")
    return s.withColumn("path", F.when(F.col("path").isNull(), lacks).otherwise(F.regexp_replace("path", "^file:/+", "file:/")))


def _read_from() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path")


def xml_rois(spark: SparkSession, files: dict[str, str], slides: DataFrame, group: str = "roi", annotation_downsample: float | None = None) -> DataFrame:
    """Boxes(wsi_id, ord, x, y, w, h) of the rectangles and axis-aligned four-point polygons of a group in each slide's XML file.

    Corners are scaled from annotation_downsample (default: that of the slide's level, before resampling) to the slide's
    downsample, held against the slide's sides where slides has w and h, and
    truncated. Other polygons, boxes beyond the slide and slides without a file fail the query; other kinds of annotation are passed over.
    All files are one read.
    """
    names = slides.columns
    own = F.col("downsample") / F.col("resample_factor") if "resample_factor" in names else F.col("downsample")
    s = slides.select("wsi_id", (F.lit(annotation_downsample) if annotation_downsample else own).alias("from"), F.col("downsample").alias("to"), *[(F.col(k) if k in names else F.lit(None)).cast("double").alias(f"s{k}") for k in "wh"])
    s = _with_files(spark, files, s)
    if files:
        rows = spark.read.format("xml").option("rowTag", "Annotation").schema(XML).load(sorted(set(files.values()))).select("*", _read_from(), F.monotonically_increasing_id().alias("ord"))
    else:
        rows = spark.createDataFrame([], XML + ", path string, ord long")
    rows = rows.filter((F.col("_PartOfGroup") == group) & F.col("_Type").isin("Rectangle", "Polygon") & F.col("Coordinates").isNotNull())
    rows = s.join(rows, "path", "left").filter("ord is not null").withColumn("scale", F.col("from") / F.col("to"))
    c = F.col("Coordinates.Coordinate")
    xs, ys = F.transform(c, lambda p: p["_X"] * F.col("scale")), F.transform(c, lambda p: p["_Y"] * F.col("scale"))
    rows = rows.withColumns({"xs": xs, "ys": ys})
    bad = (F.col("_Type") == "Polygon") & ((F.size("xs") != 4) | (F.size(F.array_distinct("xs")) != 2) | (F.size(F.array_distinct("ys")) != 2))
    rows = rows.withColumn("xs", F.when(bad, F.raise_error(F.concat(F.lit("polygon of slide "), "wsi_id", F.lit(" is no axis-aligned box"))).cast("array<double>")).otherwise(F.col("xs")))
    low, high = lambda a: F.array_min(a), lambda a: F.array_max(a)
    beyond = (low("xs") < 0) | (low("ys") < 0) | F.coalesce((high("xs") > F.col("sw")) | (high("ys") > F.col("sh")), F.lit(False))
    rows = rows.withColumn("xs", F.when(beyond, F.raise_error(F.concat(F.lit("region beyond slide "), "wsi_id")).cast("array<double>")).otherwise(F.col("xs")))
    return rows.select("wsi_id", "ord", low("xs").cast("long").alias("x"), low("ys").cast("long").alias("y"), (high("xs") - low("xs")).cast("long").alias("w"), (high("ys") - low("ys")).cast("long").alias("h"))


def csv_points(spark: SparkSession, path: str, x_col: str = "x", y_col: str = "y", label_col: str = "label") -> DataFrame:
    """px, py (truncated) and label of a CSV file with a header, in patch pixels."""
    rows = spark.read.csv(path, header=True)
    if missing := sorted({x_col, y_col, label_col} - set(rows.columns)):
        raise ValueError(f"columns {missing} are missing in {path}")
    return rows.select(F.col(x_col).cast("double").cast("long").alias("px"), F.col(y_col).cast("double").cast("long").alias("py"), F.col(label_col).cast("long").cast("int").alias("label"))


def csv_points_of(spark: SparkSession, files: dict[str, str], slides: DataFrame, x_col: str = "x", y_col: str = "y", label_col: str = "label") -> DataFrame:
    """slide_ord, px, py, label of every slide's CSV file; a file may serve several slides. A slide without a file fails the query, a file without a column too. All files are one read."""
    s = _with_files(spark, files, slides.select("slide_ord", "wsi_id"))
    if not files:
        return s.select("slide_ord", *[F.lit(None).cast(t).alias(k) for k, t in (("px", "long"), ("py", "long"), ("label", "int"))])
    paths = [_qualified(spark, p) for p in sorted(set(files.values()))]
    wanted = sorted({x_col, y_col, label_col})

    def lacking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with opened(p) as f:
                    head = f.read(65536).split(b"\n")[0].decode("utf-8-sig").strip()
                if missing := sorted(set(wanted) - set(next(csv.reader([head]), []))):
                    yield pd.DataFrame([(p, ", ".join(missing))], columns=["path", "missing"])

    heads = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000), "path")
    if bad := heads.mapInPandas(lacking, "path string, missing string").limit(3).collect():  # all headers in one pass, by executors
        raise ValueError("; ".join(f"columns {r['missing']} are missing in {r['path']}" for r in bad))
    rows = spark.read.csv(sorted(set(files.values())), header=True, enforceSchema=False)
    rows = rows.select(_read_from(), F.col(x_col).cast("double").cast("long").alias("px"), F.col(y_col).cast("double").cast("long").alias("py"), F.col(label_col).cast("long").cast("int").alias("label"))
    return s.join(rows, "path", "left").filter("px is not null and py is not null").select("slide_ord", "px", "py", "label")


def vertices_of(coords) -> list[tuple[float, float]]:
    """All vertices of coordinates nested to any depth; a third number is ignored."""
    if not coords:
        return []
    if isinstance(coords[0], (int, float)):
        return [(float(coords[0]), float(coords[1]))]
    return [v for c in coords for v in vertices_of(c)]


def shifted(coords, scale: float, dx: float, dy: float):
    """The same nesting with vertices scaled, moved and rounded half even."""
    if not coords:
        return []
    if isinstance(coords[0], (int, float)):
        return [round(coords[0] * scale - dx), round(coords[1] * scale - dy)]
    return [shifted(c, scale, dx, dy) for c in coords]


FEATURE = "fid long, properties string, geometry string, vertices array<struct<vx:double,vy:double>>"
#: Bytes of a file that are one task's; a feature is read whole by the task in whose bytes it begins.
PART = 16_000_000
_START = re.compile(rb'"features"\s*:\s*\[')


def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that begin or end strings, and of all brackets with their steps in depth; escaped: if the first byte is."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == 34)
    if len(slashes := np.flatnonzero(raw == 92)) or escaped:
        cut = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)  # first of each run of backslashes
        run = np.zeros(len(raw) + 1, np.int64)
        for i, j in zip(cut, [*cut[1:], len(slashes)][: len(cut)], strict=True):
            run[slashes[j - 1] + 1] = j - i + (escaped and slashes[i] == 0)
        run[0] += escaped and not (len(slashes) and slashes[0] == 0)
        quotes = quotes[run[quotes] % 2 == 0]
    places = np.flatnonzero((raw == 123) | (raw == 125) | (raw == 91) | (raw == 93))
    return quotes, places, np.where((raw[places] == 123) | (raw[places] == 91), 1, -1)


def _outside(quotes: np.ndarray, places: np.ndarray, inside: bool) -> np.ndarray:
    """Which places are in no string, where the first byte is inside one or not."""
    return (np.searchsorted(quotes, places) + inside) % 2 == 0


#: Bytes before a part that are looked back on: for a key whose array begins in the part.
BACK = 4096


def _bytes(path: str, at: int, n: int) -> tuple[bytes, bytes, bool]:
    """The bytes, some before them, and if the first is escaped."""
    with opened(path) as f:
        back = f.read_at(min(at, BACK), max(0, at - BACK))
        return f.read_at(n, at), back, (len(back) - len(back.rstrip(b"\\"))) % 2 == 1


SCAN = "path string, part int, at long, flips boolean, depth0 long, low0 long, depth1 long, low1 long, starts array<struct<at:long,bare:boolean,depth0:long,depth1:long,ends:boolean>>"


def _scan(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """What a part does to the state of a parser, both for one that begins outside a string (0) and inside (1): the change in depth, the lowest depth; and where arrays of features may begin, if they end in the part too."""
    for batch in parts:
        for path, part, at in zip(batch["path"], batch["part"], batch["at"], strict=True):
            data, back, escaped = _bytes(path, at, size)
            quotes, places, steps = _marks(data, escaped)
            depths = [np.cumsum(steps * _outside(quotes, places, bool(k))) for k in (0, 1)]
            row = {"path": path, "part": part, "at": at, "flips": len(quotes) % 2 == 1}
            for k, depth in enumerate(depths):
                row |= {f"depth{k}": int(depth[-1]) if len(depth) else 0, f"low{k}": min(0, int(depth.min())) if len(depth) else 0}
            opens = [(m.end() - 1 - len(back), False) for m in _START.finditer(back + data)]
            if part == 0 and data.lstrip()[:1] == b"[":
                opens = [(len(data) - len(data.lstrip()), True)]
            row["starts"] = []
            for p, bare in opens:
                if p >= 0:
                    i, k = int(np.searchsorted(places, p)), int(np.searchsorted(quotes, p)) % 2
                    d = [int(x[i]) - 1 if j == k else None for j, x in enumerate(depths)]
                    row["starts"].append({"at": at + p + 1, "bare": bare, "depth0": d[0], "depth1": d[1], "ends": bool((depths[k][i:] < depths[k][i]).any())})
            yield pd.DataFrame([row])


STATE = "path string, part int, at long, inside boolean, depth long, begins long, level long"


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a file's parts, a row for each: the state in which each begins, where the array of features begins and the depth in it; parts without features go."""
    pdf = pdf.sort_values("part")
    inside, depth, rows = False, 0, []
    begins, level, first, last, open_ = None, 2, 0, -1, False
    for i, r in enumerate(pdf.itertuples()):
        rows.append((r.path, r.part, r.at, inside, depth))
        if open_:  # the array goes on into this part
            last = i
            open_ = depth + (r.low1 if inside else r.low0) >= level
        for s in r.starts:
            here = s["depth1"] if inside else s["depth0"]
            if here is not None and not pd.isna(here) and depth + here == (0 if s["bare"] else 1):
                begins, level, first, last, open_ = int(s["at"]), 1 if s["bare"] else 2, i, i, not s["ends"]  # of several keys the last counts
        depth += r.depth1 if inside else r.depth0
        inside ^= bool(r.flips)
    if inside or depth:
        raise ValueError(f"{pdf['path'].iloc[0]} ends within a string or an object")
    if begins is None:
        raise ValueError(f"{pdf['path'].iloc[0]} has no features")
    return pd.DataFrame(rows, columns=["path", "part", "at", "inside", "depth"]).assign(begins=begins, level=level).iloc[first : last + 1]


def _objects(path: str, at: int, size: int, inside: bool, depth: int, begins: int, level: int) -> tuple[bytes, np.ndarray]:
    """The part's bytes, and where in them the features begin that are in the array: objects that open at its depth before it ends."""
    data, _, escaped = _bytes(path, at, size)
    quotes, places, steps = _marks(data, escaped)
    keep = _outside(quotes, places, inside)
    places, steps = places[keep], steps[keep]
    after = depth + np.cumsum(steps)
    ended = np.flatnonzero((after < level) & (places + at >= begins))
    raw = np.frombuffer(data, np.uint8)
    is_start = (steps == 1) & (after == level + 1) & (places + at >= begins) & (raw[places] == 123)
    if len(ended):
        is_start[ended[0] :] = False
    return data, places[is_start]


def _whole(path: str, at: int, data: bytes, start: int, step: int = 1_000_000) -> bytes:
    """The object that begins at data[start], read on beyond data where it ends later."""
    more = b""
    while True:
        text = data[start:] + more
        quotes, places, steps = _marks(text, False)
        keep = _outside(quotes, places, False)
        closed = np.flatnonzero(np.cumsum(steps[keep]) == 0)
        if len(closed):
            return text[: int(places[keep][closed[0]]) + 1]
        with opened(path) as f:
            got = f.read_at(step, at + len(data) + len(more))
        if not got:
            raise ValueError(f"{path} ends within a feature")
        more += got
        step *= 2


def _feature(text: bytes) -> tuple:
    """The feature that text begins with; what follows it is left alone."""
    f, _ = json.JSONDecoder().raw_decode(text.decode())
    g = f.get("geometry") or None
    v = vertices_of(g.get("coordinates")) if g else []
    return json.dumps(f.get("properties") or {}, sort_keys=True), json.dumps(g) if g else None, [{"vx": x, "vy": y} for x, y in v]


def geojson_features(spark: SparkSession, path: str | list[str], size: int = PART) -> DataFrame:
    """path, fid, properties (JSON), geometry (JSON), vertices of FeatureCollections or bare lists; features without geometry have no vertices.

    A file is read in parts of `size` bytes, by as many tasks. What a part does to a parser's state is worked out for
    both states that it may begin in, so that parts need not wait for each other; the states of a file's parts, one row
    each, are then chained, and each part gives the features that begin in it. No task holds more than a part and one feature.
    """
    paths = [re.sub("^file:/+", "file:/", _qualified(spark, p)) for p in ([path] if isinstance(path, str) else path)]
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with opened(p) as f:
                    n = f.size()
                yield pd.DataFrame([(p, i, i * size) for i in range(max(1, -(-n // size)))], columns=["path", "part", "at"])

    parts = hold(files.mapInPandas(sizes, "path string, part int, at long"), "geojson-parts")
    dealt = parts.repartition(max(1, min(parts.count(), 100_000)), "path", "part")
    states = hold(dealt.mapInPandas(lambda x: _scan(x, size), SCAN).groupBy("path").applyInPandas(_states, STATE), "geojson-states")
    spread = states.repartition(max(1, min(states.count(), 100_000)), "path", "part")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame([(r.path, r.part, len(_objects(r.path, r.at, size, r.inside, r.depth, r.begins, r.level)[1]))], columns=["path", "part", "n"])

    counts = spread.mapInPandas(count, "path string, part int, n long")
    before = counts.select("path", "part", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                data, starts = _objects(r.path, r.at, size, r.inside, r.depth, r.begins, r.level)
                ends = [*starts[1:], None]
                for k in range(0, len(starts), 2000):
                    own = [_feature(_whole(r.path, r.at, data, int(s)) if e is None else data[int(s) : int(e)].rstrip().rstrip(b",")) for s, e in zip(starts[k : k + 2000], ends[k : k + 2000], strict=True)]
                    out = pd.DataFrame(own, columns=["properties", "geometry", "vertices"])
                    out.insert(0, "fid", r.before + k + np.arange(len(out)))
                    yield out.assign(path=r.path)

    found = hold(states.join(before, ["path", "part"]), "geojson-begins").repartition(max(1, min(states.count(), 100_000)), "path", "part")
    return found.mapInPandas(parse, FEATURE + ", path string")


def geojson_cells(spark: SparkSession, files: dict[str, str], slides: DataFrame, offsets: dict[str, tuple[float, float]] | None = None, scale: float | None = None) -> DataFrame:
    """slide_ord, fid, properties, geometry, px, py, scale, ox, oy of every feature of each slide's GeoJSON file.

    px, py: the mean of all vertices, moved by the slide's offset (level-0 pixels) and scaled to the pixels of patches,
    by scale or else one over slides.downsample; null without vertices. A slide without a file fails the query.
    """
    names = slides.columns
    s = _with_files(spark, files, slides.select("slide_ord", "wsi_id", (F.lit(scale) if scale is not None else 1 / F.col("downsample") if "downsample" in names else F.lit(1.0)).cast("double").alias("scale")))
    moved = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in (offsets or {}).items()], "wsi_id string, ox double, oy double")
    s = s.join(moved, "wsi_id", "left").fillna(0.0, ["ox", "oy"])
    rows = geojson_features(spark, sorted(set(files.values()))) if files else spark.createDataFrame([], FEATURE + ", path string")
    mean = lambda k: F.when(F.size("vertices") > 0, F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v[k]) / F.size("vertices"))
    rows = s.join(rows, "path", "left").filter("fid is not null")
    return rows.select("slide_ord", "fid", "properties", "geometry", ((mean("vx") + F.col("ox")) * F.col("scale")).alias("px"), ((mean("vy") + F.col("oy")) * F.col("scale")).alias("py"), "scale", "ox", "oy")

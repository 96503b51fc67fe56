"""Queries over the virtual slides of the test tables, one for each operator, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemill.functions import pen, png
from slidemill.operators import annotate, audit, extract, levels, metrics, profile, rois, shards, tiles
from slidemill.operators.metrics import LUMA
from slidemill.plans import virtual
from slidemill.plans.virtual import with_views

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- slides and levels

query("slide_catalog", with_views("vslide") + " SELECT slide_ord, wsi_id, w, h FROM vslide")(lambda s, d: virtual.slides(s, d).select("slide_ord", "wsi_id", "w", "h"))

VALUE = {"mpp": "mpp0 * ds", "downsample": "ds", "level": "CAST(level AS DOUBLE)"}
PICK = {
    "nearest": "arg_min(level, abs({v} - {r}) * 1000000 + level)",
    "floor": "coalesce(arg_min(level, CASE WHEN {v} >= {r} THEN {v} END), max(level))",
    "ceil": "coalesce(arg_max(level, CASE WHEN {v} <= {r} THEN {v} END), 0)",
    "error": "min(CASE WHEN abs({v} - {r}) <= 1e-6 * greatest(1.0, {r}) THEN level END)",
}
PICK["resample"] = PICK["ceil"]


def level_sql(unit: str, mode: str, r: float) -> str:
    pick = PICK["error" if unit == "level" else mode].format(v=VALUE[unit], r=f"CAST({r} AS DOUBLE)")
    rf = f"CAST({r} AS DOUBLE) / ({VALUE[unit]})" if mode == "resample" else "CAST(1.0 AS DOUBLE)"
    dim = "CAST(round_even({c} / rf, 0) AS BIGINT)" if mode == "resample" else "{c}"
    return f"""{with_views("vlevel")}, c AS (SELECT slide_ord, {pick} AS level FROM vlevel GROUP BY slide_ord),
j AS (SELECT slide_ord, level, ds, lw, lh, {rf} AS rf FROM c JOIN vlevel USING (slide_ord, level))
SELECT slide_ord, CAST(level AS INT) AS level, ds * rf AS downsample, rf AS resample_factor, {dim.format(c="lw")} AS w, {dim.format(c="lh")} AS h FROM j"""


def level_query(unit: str, mode: str, r: float):
    return lambda s, d: levels.select_level(virtual.levels(s, d), r, unit, mode, max_relative_deviation=None)


for unit, mode, r in [
    ("mpp", "nearest", 1.1), ("mpp", "floor", 0.9), ("mpp", "ceil", 0.9), ("mpp", "resample", 0.8), ("downsample", "nearest", 3.0), ("downsample", "floor", 3.0),
    ("downsample", "ceil", 3.0), ("downsample", "error", 4.0), ("downsample", "resample", 3.0), ("downsample", "resample_up", 0.5),
]:
    query(f"level_{mode}_{unit}", level_sql(unit, mode.split("_")[0], r))(level_query(unit, mode.split("_")[0], r))
query("level_index", level_sql("level", "nearest", 2))(level_query("level", "nearest", 2))
query("level_error_mpp", level_sql("mpp", "error", 1.0))(lambda s, d: levels.select_level(virtual.levels(s, d), 1.0, "mpp", "error", on_error="skip"))
query("resample_virtual_dims", "SELECT slide_ord, round(resample_factor, 9) AS rf, w AS vw, h AS vh FROM (" + level_sql("mpp", "resample", 0.7) + ")")(
    lambda s, d: level_query("mpp", "resample", 0.7)(s, d).select("slide_ord", F.round("resample_factor", 9).alias("rf"), F.col("w").alias("vw"), F.col("h").alias("vh"))
)

# ---- regions of interest

query("roi_rect", with_views("vroi") + " SELECT slide_ord, roi_index, x, y, w, h FROM vroi")(
    lambda s, d: rois.rect_rois(virtual.slides(s, d), virtual.rois(s, d).select("wsi_id", F.col("roi_index").alias("ord"), "x", "y", "w", "h")).select("slide_ord", F.col("ord").alias("roi_index"), "x", "y", "w", "h")
)


def attached(s, d):
    """Boxes of the slides with an even number of regions first, then those of all from the third on; whole slides where there are none."""
    r, sl = virtual.rois(s, d), virtual.slides(s, d)
    boxes = lambda df: rois.rect_rois(sl, df.select("wsi_id", F.col("roi_index").alias("ord"), "x", "y", "w", "h"))
    return rois.attach_rois(sl, [boxes(r.filter("roi_index >= 3")), boxes(r.filter("roi_index < 1 and slide_ord % 3 = 0"))], on_empty="whole_slide")


ATTACHED = with_views("vroi") + """, u AS (SELECT slide_ord, 0 AS p, roi_index AS o, x, y, w, h FROM vroi WHERE roi_index >= 3 UNION ALL SELECT slide_ord, 1, roi_index, x, y, w, h FROM vroi WHERE roi_index < 1 AND slide_ord % 3 = 0),
a AS (SELECT * FROM u UNION ALL SELECT slide_ord, 2, 0, 0, 0, w, h FROM vslide WHERE slide_ord NOT IN (SELECT slide_ord FROM u))
SELECT slide_ord, row_number() OVER (PARTITION BY slide_ord ORDER BY p, o) - 1 AS roi_index, x, y, w, h FROM a"""
query("roi_union_providers", ATTACHED)(lambda s, d: attached(s, d).select("slide_ord", "roi_index", "x", "y", "w", "h"))
query("roi_on_empty_whole_slide", with_views("vroi") + " SELECT slide_ord, CAST(0 AS BIGINT) AS roi_index, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, w, h FROM vslide WHERE slide_ord NOT IN (SELECT slide_ord FROM vroi WHERE roi_index >= 6)")(
    lambda s, d: rois.attach_rois(virtual.slides(s, d), [virtual.rois(s, d).filter("roi_index >= 6").withColumn("ord", F.col("roi_index"))], "whole_slide").filter("x = 0 and y = 0 and w = sw and h = sh").select("slide_ord", "roi_index", "x", "y", "w", "h")
)
query("roi_subdivide", with_views("vroi") + """, a AS (SELECT *, unnest(range(0, h, 300)) AS oy FROM vroi), b AS (SELECT *, unnest(range(0, w, 300)) AS ox FROM a),
c AS (SELECT slide_ord, roi_index, x + ox AS x, y + oy AS y, least(300, w - ox) // 48 * 48 AS w, least(300, h - oy) // 48 * 48 AS h FROM b) SELECT * FROM c WHERE w >= 64 AND h >= 64""")(
    lambda s, d: rois.subdivide(virtual.rois(s, d), 300, 64, 48)
)

# ---- tiles and windows


def tiles_sql(ts: int, stride: int, mode: str = "any_overlap") -> str:
    """CTEs up to t: all tiles of the regions."""
    axis = lambda b, e: f"CASE WHEN {e} - {b} <= {ts} THEN [{b}] ELSE range({b}, {e} - {max(0, ts - stride)}, {stride}) END"
    test = {"any_overlap": "true", "full_inside_bounds": f"x + {ts} <= b_x + bw AND y + {ts} <= b_y + bh", "center_in_roi": f"x + {ts / 2} < b_x + bw AND y + {ts / 2} < b_y + bh"}[mode]
    return f"""{with_views("vroi")}, r AS (SELECT slide_ord, roi_index, x AS b_x, y AS b_y, w AS bw, h AS bh, sw, sh, least(x + w, sw) AS x_end, least(y + h, sh) AS y_end FROM vroi),
g0 AS (SELECT *, {axis("b_x", "x_end")} AS xs, {axis("b_y", "y_end")} AS ys FROM r), g1 AS (SELECT *, unnest(ys) AS y, unnest(range(len(ys))) AS iy FROM g0),
g AS (SELECT *, unnest(xs) AS x, unnest(range(len(xs))) AS ix FROM g1), t AS (SELECT *, iy * len(xs) + ix AS tile_ord FROM g WHERE {test})"""


for name, ts, stride, mode in [("any_overlap", 224, 224, "any_overlap"), ("full_inside", 128, 128, "full_inside_bounds"), ("center", 128, 128, "center_in_roi"), ("overlap_stride", 128, 64, "any_overlap"), ("gap_stride", 96, 160, "any_overlap")]:
    query(f"tiles_{name}", tiles_sql(ts, stride, mode) + " SELECT slide_ord, roi_index, x, y FROM t")(
        lambda s, d, ts=ts, stride=stride, mode=mode: tiles.plan_tiles(virtual.rois(s, d), ts, stride, mode).select("slide_ord", "roi_index", "x", "y")
    )



def in_disc(x, y):
    """If a tile's centre is in the disc that fills the region's box, in half pixels."""
    dx, dy, side = 2 * (x + 32) - (2 * F.col("bx") + F.col("bw")), 2 * (y + 32) - (2 * F.col("by") + F.col("bh")), F.least("bw", "bh")
    return dx * dx + dy * dy <= side * side


query("tiles_in_discs", tiles_sql(64, 64) + " SELECT slide_ord, roi_index, x, y, tile_ord FROM t WHERE (2 * (x + 32) - (2 * b_x + bw)) ** 2 + (2 * (y + 32) - (2 * b_y + bh)) ** 2 <= least(bw, bh) ** 2")(
    lambda s, d: tiles.plan_tiles(virtual.rois(s, d), 64, 64, accept=in_disc).select("slide_ord", "roi_index", "x", "y", "tile_ord")
)

TS, STRIDE, MWS = 128, 96, 288


def windowed(s, d):
    return tiles.with_windows(tiles.plan_tiles(virtual.rois(s, d), TS, STRIDE), TS, STRIDE, MWS)


def _n(b, e):
    return f"greatest(1, CAST(ceil(({e} - {b}) / {MWS}.0) AS BIGINT))"


WINDOWED = tiles_sql(TS, STRIDE) + f""", w0 AS (SELECT *, least(greatest((x - b_x) // {MWS}, 0), {_n("b_x", "x_end")} - 1) AS wx, least(greatest((y - b_y) // {MWS}, 0), {_n("b_y", "y_end")} - 1) AS wy FROM t),
w1 AS (SELECT *, wy * {_n("b_x", "x_end")} + wx AS win_key, b_x + wx * {MWS} AS rx, b_y + wy * {MWS} AS ry FROM w0),
w AS (SELECT *, least(least({MWS}, x_end - rx) + {max(0, TS - STRIDE)}, x_end - rx) AS rw, least(least({MWS}, y_end - ry) + {max(0, TS - STRIDE)}, y_end - ry) AS rh FROM w1)"""
GROWN = WINDOWED + f""", m AS (SELECT * EXCLUDE (rw, rh), greatest(rw, least(max(x) OVER p - rx + {TS}, sw - rx)) AS rw, greatest(rh, least(max(y) OVER p - ry + {TS}, sh - ry)) AS rh
FROM w WINDOW p AS (PARTITION BY slide_ord, roi_index, win_key))"""
ONE = " SELECT slide_ord, roi_index, win_key, min(rx) AS rx, min(ry) AS ry, min(rw) AS rw, min(rh) AS rh, count(*) AS n_tiles FROM {} GROUP BY slide_ord, roi_index, win_key"
query("read_windows", WINDOWED + ONE.format("w"))(lambda s, d: tiles.read_windows(windowed(s, d)))
query("read_windows_expanded", GROWN + ONE.format("m"))(lambda s, d: tiles.read_windows(windowed(s, d), grow=TS))


def at_level0(s, d):
    lv = levels.select_level(virtual.levels(s, d), 3.0, "downsample", "resample", None).select("slide_ord", "downsample", "resample_factor")
    return tiles.level0_origin(tiles.read_windows(windowed(s, d)).join(lv, "slide_ord")).select("slide_ord", "roi_index", "win_key", "x0", "y0", "read_w", "read_h")


query("level0_origin", WINDOWED + """, o AS (""" + ONE.format("w") + """), l AS (SELECT slide_ord, ds AS lds, 3.0::DOUBLE / ds AS rf FROM (SELECT slide_ord, max(ds) AS ds FROM (""" + with_views("vlevel") + """ SELECT * FROM vlevel WHERE ds <= 3.0) GROUP BY slide_ord))
SELECT slide_ord, roi_index, win_key, CAST(round_even(rx * (lds * rf), 0) AS BIGINT) AS x0, CAST(round_even(ry * (lds * rf), 0) AS BIGINT) AS y0,
  CAST(round_even(rw * rf, 0) AS BIGINT) AS read_w, CAST(round_even(rh * rf, 0) AS BIGINT) AS read_h FROM o JOIN l USING (slide_ord)""")(at_level0)
PAD = f", d AS (SELECT *, {TS} - least({TS}, rw - (x - rx)) AS pad_w, {TS} - least({TS}, rh - (y - ry)) AS pad_h FROM w)"
query("edge_policy_drop", WINDOWED + PAD + " SELECT slide_ord, roi_index, x, y FROM d WHERE pad_w = 0 AND pad_h = 0")(lambda s, d: tiles.with_padding(windowed(s, d), TS).select("slide_ord", "roi_index", "x", "y"))
query("edge_policy_pad_extent", WINDOWED + PAD + " SELECT slide_ord, roi_index, x, y, pad_w, pad_h FROM d")(lambda s, d: tiles.with_padding(windowed(s, d), TS, "zeros").select("slide_ord", "roi_index", "x", "y", "pad_w", "pad_h"))
query("batch_assignment", WINDOWED + PAD + """, k AS (SELECT *, (row_number() OVER (PARTITION BY slide_ord, roi_index, win_key ORDER BY tile_ord) - 1) // 4 AS part FROM d WHERE pad_w = 0 AND pad_h = 0),
b AS (SELECT *, dense_rank() OVER (PARTITION BY slide_ord ORDER BY roi_index, win_key, part) - 1 AS batch_ord FROM k) SELECT slide_ord, roi_index, win_key, batch_ord, count(*) AS n FROM b GROUP BY ALL""")(
    lambda s, d: tiles.with_batches(tiles.with_padding(windowed(s, d), TS), 4).groupBy("slide_ord", "roi_index", "win_key", "batch_ord").agg(F.count("*").alias("n"))
)

# ---- edge distance and audit


def grid(s, d, ts=224, wanted=None):
    """Whole-slide grids with the metrics of the audit: edge distance, and two made from the place. wanted: a test that slides pass."""
    sl = virtual.slides(s, d) if wanted is None else virtual.slides(s, d).filter(wanted)
    whole = tiles.dealt(rois.attach_rois(sl, [rois.whole_slides(sl)]), sl.count())
    t = tiles.with_edge_distance(tiles.plan_tiles(whole, ts, ts), ts)
    return t.withColumns({"tissue_fraction": ((F.col("x") * 7 + F.col("y") * 13 + F.col("slide_ord") * 31) % 101) / 100.0, "gray_range": F.when((F.col("x") + F.col("y")) % 5 != 0, ((F.col("x") * 3 + F.col("y") * 11) % 97) / 96.0)})


GRID = with_views("vslide") + """, r AS (SELECT slide_ord, w AS sw, h AS sh, CASE WHEN w <= 224 THEN [0] ELSE range(0, w, 224) END AS xs, CASE WHEN h <= 224 THEN [0] ELSE range(0, h, 224) END AS ys FROM vslide),
g1 AS (SELECT *, unnest(ys) AS y FROM r), g2 AS (SELECT slide_ord, sw, sh, y, unnest(xs) AS x FROM g1),
g AS (SELECT slide_ord, x, y, least(x // 224, y // 224, CAST(ceil((sw - x) / 224.0) AS BIGINT) - 1, CAST(ceil((sh - y) / 224.0) AS BIGINT) - 1) AS edge_distance,
  ((x * 7 + y * 13 + slide_ord * 31) % 101) / 100.0::DOUBLE AS tissue_fraction, CASE WHEN (x + y) % 5 <> 0 THEN ((x * 3 + y * 11) % 97) / 96.0::DOUBLE END AS gray_range FROM g2)"""
query("edge_distance", GRID + " SELECT slide_ord, x, y, edge_distance FROM g")(lambda s, d: grid(s, d).select("slide_ord", "x", "y", "edge_distance"))
query("remove_edge_tiles", GRID + " SELECT slide_ord, x, y, edge_distance FROM g WHERE edge_distance >= 1")(
    lambda s, d: tiles.remove_edge_tiles(tiles.plan_tiles(rois.whole_slides(virtual.slides(s, d)).withColumn("roi_index", F.lit(0)), 224, 224), 224, 1).select("slide_ord", "x", "y", "edge_distance")
)
def cornered(s, d, test):
    """Tiles of whole-slide grids by the four-corner tests that regions of any shape go by."""
    r = virtual.rois(s, d).select("slide_ord", "roi_index", *[F.col(c).alias(f"r{c}") for c in "xywh"], "sw", "sh")
    return tiles.grid_tiles_at(r, 224).filter(test(F.col("x"), F.col("y"), 224)).select("slide_ord", "roi_index", "x", "y")


IN_BOX = "({0} >= rx AND {0} < rx + rw AND {1} >= ry AND {1} < ry + rh)"
CORNERS = [IN_BOX.format(a, b) for a in ("x", "x + 223") for b in ("y", "y + 223")]
CORNERED = GRID.replace(", r AS", ", " + virtual.SQL["vroi"] + ", r AS", 1) + ", cc AS (SELECT g.slide_ord, roi_index, g.x, g.y, v.x AS rx, v.y AS ry, v.w AS rw, v.h AS rh FROM g JOIN vroi v USING (slide_ord)) SELECT slide_ord, roi_index, x, y FROM cc WHERE "
query("tiles_meeting_rois", CORNERED + " OR ".join(CORNERS))(lambda s, d: cornered(s, d, rois.intersects_patch))
query("tiles_within_rois", CORNERED + " AND ".join(CORNERS))(lambda s, d: cornered(s, d, rois.contains_patch))
KNOBS = [audit.Knob("otsu", "tissue_fraction", ">=", 0.35), audit.Knob("low_contrast", "gray_range", ">=", 0.2), audit.Knob("edge", "edge_distance", ">=", 1, integer=True)]
TEST = {"otsu": "tissue_fraction < {}", "low_contrast": "coalesce(gray_range < {}, false)", "edge": "edge_distance < {}"}
AT = {"otsu": 0.35, "low_contrast": 0.2, "edge": 1}


def resolved_sql(order=("otsu", "low_contrast", "edge"), values=None) -> str:
    v = AT | (values or {})
    return GRID + ", s AS (SELECT *, CASE " + " ".join(f"WHEN {TEST[k].format(v[k])} THEN {i}" for i, k in enumerate(order, 1)) + " END AS hit FROM g)"


def funnel_sql(order=("otsu", "low_contrast", "edge"), values=None) -> str:
    rows = ["SELECT slide_ord, 0 AS stage_ord, 'source' AS stage, count(*) AS n_in, count(*) AS n_out, CAST(0 AS BIGINT) AS dropped FROM s GROUP BY slide_ord"]
    rows += [f"SELECT slide_ord, {i}, '{k}', count(*) FILTER (hit IS NULL OR hit >= {i}), count(*) FILTER (hit IS NULL OR hit > {i}), count(*) FILTER (hit = {i}) FROM s GROUP BY slide_ord" for i, k in enumerate(order, 1)]
    return resolved_sql(order, values) + " " + " UNION ALL ".join(rows)


query("audit_funnel", funnel_sql())(lambda s, d: audit.funnel(grid(s, d), KNOBS))
query("audit_what_if", funnel_sql(values={"otsu": 0.15, "edge": 2}))(lambda s, d: audit.funnel(grid(s, d), audit.tuned(KNOBS, {"otsu": 0.15, "edge": 2})))
query("audit_reordered", funnel_sql(("edge", "low_contrast", "otsu")))(lambda s, d: audit.funnel(grid(s, d), audit.tuned(KNOBS, order=["edge", "low_contrast", "otsu"])))
query("audit_stage_off", funnel_sql(("otsu", "edge")))(lambda s, d: audit.funnel(grid(s, d), audit.tuned(KNOBS, off=["low_contrast"])))
query("audit_dropped_by", resolved_sql() + " SELECT slide_ord, x, y, CASE hit WHEN 1 THEN 'otsu' WHEN 2 THEN 'low_contrast' WHEN 3 THEN 'edge' END AS dropped_by FROM s")(
    lambda s, d: audit.resolve(grid(s, d), KNOBS).select("slide_ord", "x", "y", "dropped_by")
)
query("audit_seen", resolved_sql() + " SELECT slide_ord, x, y, array_to_string(list_slice(['otsu', 'low_contrast', 'edge'], 1, coalesce(hit, 3)), '>') AS seen FROM s")(
    lambda s, d: audit.reached(grid(s, d), KNOBS).select("slide_ord", "x", "y", F.array_join("seen", ">").alias("seen"))
)

# ---- pixel metrics

GRAY = " + ".join(f"{c} / 255.0::DOUBLE * {w}" for c, w in zip("rgb", LUMA, strict=True))
PX = with_views("vpx") + f", q AS (SELECT *, {GRAY} AS gray FROM vpx)"
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
GSTAT = PX + ", e AS (SELECT patch_id, min(gray) AS gray_min, max(gray) AS gray_max, max(gray) - min(gray) AS gray_range FROM q GROUP BY patch_id)"
GOUT = " SELECT patch_id, round(gray_min, 6) AS gray_min, round(gray_max, 6) AS gray_max, round(gray_range, 6) AS gray_range FROM e"
query("gray_stats", GSTAT + GOUT)(lambda s, d: r6(metrics.gray_stats(virtual.pixels(s, d)), "gray_min", "gray_max", "gray_range"))
query("low_contrast_filter", GSTAT + GOUT + " WHERE gray_range >= 0.34")(lambda s, d: r6(metrics.low_contrast_filter(virtual.pixels(s, d), 0.34), "gray_min", "gray_max", "gray_range"))


def _pen_sql() -> str:
    mode = lambda m: " AND ".join("(" + " OR ".join(f"{c} {'>' if up else '<'} {v}" for c, v, up in zip("rgb", t, pen.ABOVE[m], strict=True)) + ")" for t in pen.MODES[m])
    return f"NOT (({mode('red')}) AND ({mode('green')}) AND ({mode('blue')})) AND NOT (r + g + b < 15)"


PEN = PX + f", p AS (SELECT patch_id, count(*) FILTER ({_pen_sql()}) AS pen_pixel_count, count(*) AS n FROM vpx GROUP BY patch_id) SELECT patch_id, pen_pixel_count, round(pen_pixel_count / n, 6) AS pen_fraction FROM p"
query("pen_fraction", PEN)(lambda s, d: r6(metrics.pen_stats(virtual.pixels(s, d)), "pen_fraction"))
query("pen_filter", PEN + " WHERE pen_pixel_count / n <= 0.14")(lambda s, d: r6(metrics.pen_filter(virtual.pixels(s, d), max_pen_fraction=0.14), "pen_fraction"))
NB = 16
OTSU = PX + f""", e AS (SELECT patch_id, min(gray) AS lo, max(gray) AS hi, count(*) AS tot FROM q GROUP BY patch_id),
hb AS (SELECT patch_id, least(greatest(CAST(floor(least(greatest((gray - lo) / greatest(hi - lo, 1e-12), 0), 1) * {NB} - 1e-7) AS BIGINT), 0), {NB - 1}) AS bin, count(*) AS h FROM q JOIN e USING (patch_id) GROUP BY ALL),
f AS (SELECT patch_id, lo, hi, tot, bin, coalesce(h, 0) AS h FROM (SELECT *, unnest(range({NB})) AS bin FROM e) LEFT JOIN hb USING (patch_id, bin)),
c AS (SELECT *, sum(h) OVER o AS w1, sum(h * ((bin + 0.5) / {NB})::DOUBLE) OVER o AS s1, sum(h * ((bin + 0.5) / {NB})::DOUBLE) OVER (PARTITION BY patch_id) AS al FROM f WINDOW o AS (PARTITION BY patch_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, tot - w1 AS w2, CASE WHEN w1 = 0 THEN 0 ELSE s1 / w1 END AS m1, CASE WHEN tot - w1 = 0 THEN 0 ELSE (al - s1) / (tot - w1) END AS m2 FROM c),
n AS (SELECT *, round(w1 * lead(w2) OVER o * (m1 - lead(m2) OVER o) ^ 2, 9) AS score FROM m WINDOW o AS (PARTITION BY patch_id ORDER BY bin)),
k AS (SELECT patch_id, lo, hi, bin, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, bin) AS rn FROM n WHERE bin < {NB - 1}),
th AS (SELECT patch_id, CASE WHEN hi <= lo THEN lo ELSE lo + (bin + 0.5) / {NB} * greatest(hi - lo, 1e-12) END AS thr FROM k WHERE rn = 1),
o AS (SELECT patch_id, thr, count(*) FILTER (gray < thr) AS dark, count(*) FILTER (gray >= thr) AS bright, count(*) AS n FROM q JOIN th USING (patch_id) GROUP BY ALL)"""
query("otsu_threshold", OTSU + " SELECT patch_id, round(thr, 6) AS otsu_threshold FROM o")(lambda s, d: r6(metrics.otsu_thresholds(virtual.pixels(s, d), NB), "otsu_threshold"))
OUT = " SELECT patch_id, round(thr, 6) AS otsu_threshold, round({0} / n, 6) AS tissue_fraction, {0} AS tissue_pixel_count FROM o WHERE {0} / n >= {1}"
query("otsu_filter_dark", OTSU + OUT.format("dark", 0.39))(lambda s, d: r6(metrics.otsu_filter(virtual.pixels(s, d), NB, True, 0.39), "otsu_threshold", "tissue_fraction"))
query("otsu_filter_bright", OTSU + OUT.format("bright", 0.6))(lambda s, d: r6(metrics.otsu_filter(virtual.pixels(s, d), NB, False, 0.6), "otsu_threshold", "tissue_fraction"))


def _lab_sql() -> str:
    from slidemill.functions.colour import RGB_TO_XYZ, WHITE

    lin = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN (({c} / 255.0::DOUBLE + 0.055) / 1.055) ^ 2.4 ELSE {c} / 255.0::DOUBLE / 12.92 END AS l{c}" for c in "rgb")
    xyz = ", ".join("(" + " + ".join(f"l{c} * {m}" for c, m in zip("rgb", row, strict=True)) + f") / {w}::DOUBLE AS {n}" for n, row, w in zip("xyz", RGB_TO_XYZ, WHITE, strict=True))
    f = ", ".join(f"CASE WHEN {n} > 0.008856 THEN {n} ^ (1 / 3.0::DOUBLE) ELSE 7.787 * {n} + 4.0 / 29.0::DOUBLE END AS f{n}" for n in "xyz")
    return f", li AS (SELECT patch_id, {lin} FROM vpx), xy AS (SELECT patch_id, {xyz} FROM li), ff AS (SELECT patch_id, {f} FROM xy), lab AS (SELECT patch_id, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM ff)"


LAB = PX + _lab_sql() + ", ls AS (SELECT patch_id, " + ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in "lab") + " FROM lab GROUP BY patch_id)"
LABCOLS = [f"{k}_{c}" for c in "lab" for k in ("mean", "std")]
query("lab_stats", LAB + " SELECT patch_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in LABCOLS) + " FROM ls")(lambda s, d: metrics.lab_stats(virtual.pixels(s, d)).withColumns({c: F.round(c, 4) for c in LABCOLS}))
REF = {"l": (65.0, 10.0), "a": (5.0, 8.0), "b": (-5.0, 6.0)}
query("reinhard_stats", LAB + " SELECT patch_id, " + ", ".join(f"round({sd} / (std_{c} + 1e-8), 4) AS scale_{c}, round({mu} - mean_{c}, 4) AS shift_{c}" for c, (mu, sd) in REF.items()) + " FROM ls")(
    lambda s, d: metrics.lab_stats(virtual.pixels(s, d)).select("patch_id", *[e for c, (mu, sd) in REF.items() for e in (F.round(sd / (F.col(f"std_{c}") + 1e-8), 4).alias(f"scale_{c}"), F.round(mu - F.col(f"mean_{c}"), 4).alias(f"shift_{c}"))])
)
query("od_background_mask", PX + ", od AS (SELECT patch_id, " + ", ".join(f"-ln(greatest(1, {c}) / 255.0::DOUBLE) AS o_{c}" for c in "rgb") + " FROM vpx) SELECT patch_id, count(*) FILTER (sqrt(o_r ^ 2 + o_g ^ 2 + o_b ^ 2) >= 0.15) AS n_stained, round(avg(o_r), 6) AS od_r, round(avg(o_g), 6) AS od_g, round(avg(o_b), 6) AS od_b FROM od GROUP BY patch_id")(
    lambda s, d: r6(metrics.optical_density_stats(virtual.pixels(s, d)), "od_r", "od_g", "od_b")
)

# ---- annotations


def point_tiles(s, d, ts=128, stride=64):
    return tiles.plan_tiles(virtual.rois(s, d), ts, stride).select("slide_ord", "roi_index", "x", "y")


IN = " t.slide_ord = p.slide_ord AND p.px >= t.x AND p.px < t.x + 128 AND p.py >= t.y AND p.py < t.y + 128"
NOTE = ", string_agg(CAST(p.px - t.x AS INT) || ':' || CAST(p.py - t.y AS INT) || ':' || p.label, ' ' ORDER BY p.px - t.x, p.py - t.y, p.label)"
notes = lambda c: F.array_join(F.transform(c, lambda a: F.concat_ws(":", a["x"].cast("string"), a["y"].cast("string"), a["label"].cast("string"))), " ")
POINTS = tiles_sql(128, 64).replace(", r AS", ", " + virtual.SQL["vpoint"] + ", r AS", 1) + f", u AS (SELECT t.slide_ord, t.roi_index, t.x, t.y, count(p.px) AS n, coalesce({NOTE[2:]}, '') AS labels FROM t LEFT JOIN vpoint p ON {IN} GROUP BY t.slide_ord, t.roi_index, t.x, t.y)"
query("points_in_tiles", POINTS + " SELECT * FROM u")(
    lambda s, d: annotate.annotate_points(point_tiles(s, d), virtual.points(s, d), 128, copy="points").select("slide_ord", "roi_index", "x", "y", F.size("annotations").cast("long").alias("n"), notes("annotations").alias("labels"))
)
query("points_filter_empty", POINTS + " SELECT * FROM u WHERE n > 0")(
    lambda s, d: annotate.annotate_points(point_tiles(s, d), virtual.points(s, d), 128, filter_empty=True, copy="points").select("slide_ord", "roi_index", "x", "y", F.size("annotations").cast("long").alias("n"), notes("annotations").alias("labels"))
)
FEATURES = tiles_sql(128, 64).replace(", r AS", ", " + virtual.SQL["vfeature"] + ", r AS", 1) + """, ce AS (SELECT slide_ord, fid, celltype, k, (cx + 3.0) * 0.5 AS px, (cy - 2.0) * 0.5 AS py, half FROM vfeature),
fj AS (SELECT t.roi_index, t.x, t.y, p.* FROM t JOIN ce p ON""" + IN + ")"


def geo(s, d):
    c = annotate.centroids(virtual.features(s, d), 0.5, 3.0, -2.0, carry=("celltype", "k"))
    return annotate.points_in_tiles(point_tiles(s, d), c, 128, copy="points")


query("geo_centroid_join", FEATURES + " SELECT slide_ord, roi_index, x, y, fid, px, py FROM fj")(lambda s, d: geo(s, d).select("slide_ord", "roi_index", "x", "y", "fid", "px", "py"))
query("geo_property_subset", FEATURES + " SELECT slide_ord, roi_index, x, y, celltype, count(*) AS n, sum(k) AS k FROM fj GROUP BY slide_ord, roi_index, x, y, celltype")(
    lambda s, d: geo(s, d).groupBy("slide_ord", "roi_index", "x", "y", "celltype").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
)


def geo_cells(s, d):
    """Features as a GeoJSON file gives them: properties as JSON, and a point for their shape, as centroids need no more."""
    c = annotate.centroids(virtual.features(s, d), 0.5, 3.0, -2.0, carry=("celltype", "k"))
    c = c.withColumns({"properties": F.to_json(F.struct("celltype", "k")), "geometry": F.lit(None).cast("string"), "scale": F.lit(0.5), "ox": F.lit(3.0), "oy": F.lit(-2.0)}).drop("celltype", "k")
    met = annotate.annotate_features(point_tiles(s, d), c, 128, ("celltype", "colour"), filter_empty=True, copy="points")
    return met.select("slide_ord", "roi_index", "x", "y", F.array_join("annotations", " ").alias("cells"))


query("geo_annotated_tiles", FEATURES + """ SELECT slide_ord, roi_index, x, y, string_agg('{"celltype": "' || celltype || '", "colour": null}', ' ' ORDER BY fid) AS cells FROM fj GROUP BY slide_ord, roi_index, x, y""")(geo_cells)
query("geo_shifted_vertices", FEATURES + """, vv AS (SELECT roi_index, x, y, slide_ord, fid, half, unnest([-1, 1, 1, -1]) AS a, unnest([-1, -1, 1, 1]) AS b FROM fj), vx AS (SELECT vv.*, cx, cy FROM vv JOIN vfeature USING (slide_ord, fid))
SELECT slide_ord, roi_index, x, y, fid, CAST(round_even((cx + a * vx.half) * 0.5 - (x - 3.0 * 0.5), 0) AS BIGINT) AS vx, CAST(round_even((cy + b * vx.half) * 0.5 - (y + 2.0 * 0.5), 0) AS BIGINT) AS vy FROM vx""")(
    lambda s, d: geo(s, d).select("slide_ord", "roi_index", "x", "y", "fid").join(virtual.features(s, d), ["slide_ord", "fid"])
    .select("slide_ord", "roi_index", "x", "y", "fid", annotate.shift_vertex(F.col("vx"), F.col("x"), 0.5, 3.0).alias("vx"), annotate.shift_vertex(F.col("vy"), F.col("y"), 0.5, -2.0).alias("vy"))
)

# ---- profile and shards


def messages(s, d):
    e = virtual.table(s, d, "events")
    return e.select(F.col("user_id").alias("slide_id"), F.col("event_type").alias("stage"), F.col("value").alias("wall_s"), (F.col("event_id") % 4).alias("n"), F.col("event_id").alias("ord"))


MSG = "WITH m AS (SELECT user_id AS slide_id, event_type AS stage, value AS wall_s, event_id % 4 AS n, event_id AS ord FROM events)"
MS = "CASE WHEN n > 0 THEN wall_s / n * 1000 ELSE 0 END"
query("profile_by_stage", MSG + f", a AS (SELECT stage, sum(wall_s) AS wall_s, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY stage) SELECT stage, round(wall_s, 4) AS wall_s, n, round({MS}, 4) AS avg_ms FROM a")(
    lambda s, d: profile.by_stage(messages(s, d)).withColumns({"wall_s": F.round("wall_s", 4), "avg_ms": F.round("avg_ms", 4)})
)
query("profile_by_slide", MSG + f", a AS (SELECT slide_id, stage, arg_max(wall_s, ord) AS wall_s, arg_max(n, ord) AS n FROM m GROUP BY slide_id, stage) SELECT slide_id, stage, round(wall_s, 6) AS wall_s, n, round({MS}, 4) AS avg_ms FROM a")(
    lambda s, d: profile.by_slide(messages(s, d)).withColumns({"wall_s": F.round("wall_s", 6), "avg_ms": F.round("avg_ms", 4)})
)


def keyed(s, d, prefixes=()):
    """Keys of all tiles; with prefixes, of the slides that can have such keys."""
    stem = F.concat(F.lit("slide_"), "slide_ord")
    return grid(s, d, wanted=shards.may_start(F.concat(stem, F.lit("_")), list(prefixes))).select(shards.sample_key(stem, F.col("x"), F.col("y")).alias("key"))


def prefixed(s, d, prefixes=("slide_1_", "slide_42", "slide_199")):
    return shards.keep_prefixes(keyed(s, d, prefixes), list(prefixes))


KEYED = GRID + ", kk AS (SELECT 'slide_' || slide_ord || '_' || x || '_' || y AS key FROM g)"
query("shard_assignment", KEYED + " SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx, (row_number() OVER (ORDER BY key) - 1) // 200 AS shard_id FROM kk")(lambda s, d: shards.assign_shards(keyed(s, d), 200, [F.col("key")], ranges=8))
query("loader_prefix_filter", KEYED + " SELECT key FROM kk WHERE starts_with(key, 'slide_1_') OR starts_with(key, 'slide_42') OR starts_with(key, 'slide_199')")(prefixed)

# ---- pixel work in Arrow batches

ARROW = OTSU.replace("SELECT patch_id, thr, count(*)", "SELECT patch_id, thr, min(gray) AS glo, max(gray) AS ghi, count(*)")
query("patch_metrics_arrow", ARROW + f", pp AS (SELECT patch_id, count(*) FILTER ({_pen_sql()}) AS pen_pixel_count, count(*) AS np FROM vpx GROUP BY patch_id) SELECT patch_id, round(ghi - glo, 6) AS gray_range, round(thr, 6) AS otsu_threshold, round(dark / n, 6) AS tissue_fraction, dark AS tissue_pixel_count, round(pen_pixel_count / np, 6) AS pen_fraction FROM o JOIN pp USING (patch_id)")(
    lambda s, d: r6(extract.measure(virtual.patches(s, d), NB, precision="float64"), "gray_range", "otsu_threshold", "tissue_fraction", "pen_fraction").select("patch_id", "gray_range", "otsu_threshold", "tissue_fraction", "tissue_pixel_count", "pen_fraction")
)


def batched(s, d):
    """Virtual patches in the columns that cut patches have."""
    return virtual.patches(s, d).select(F.col("slide_ord").cast("int").alias("slide_ord"), F.concat(F.lit("slide_"), "slide_ord").alias("wsi_id"), F.lit(0).cast("long").alias("roi_index"), "x", "y", F.col("patch_id").alias("tile_ord"), F.floor(F.col("y") / 16).alias("batch_ord"), "pixels", "ph", "pw", "pc")


checksum = lambda df, c="pixels": df.select("slide_ord", "x", "y", F.crc32(c).alias("crc"))
query("reinhard_apply")(lambda s, d: checksum(extract.reinhard(batched(s, d), [65.0, 5.0, -5.0], [10.0, 8.0, 6.0])))
query("reinhard_modified_apply")(lambda s, d: checksum(extract.reinhard(batched(s, d), [65.0, 5.0, -5.0], [10.0, 8.0, 6.0], modified=True)))
query("macenko_apply")(lambda s, d: checksum(extract.macenko(batched(s, d))))
query("png_encode")(lambda s, d: checksum(extract.encode_png(batched(s, d)), "encoded"))


def decoded(s, d):
    """Sums of the pixels that come back from PNG files."""

    @F.pandas_udf("long")
    def total(files: pd.Series) -> pd.Series:
        return pd.Series([int(png.decode(f).sum(dtype="int64")) for f in files], dtype="int64")

    return extract.encode_png(batched(s, d)).select(F.col("tile_ord").alias("patch_id"), "x", "y", total("encoded").alias("total"))


query("png_roundtrip", with_views("vpx") + """, n AS (SELECT patch_id, row_number() OVER (PARTITION BY slide_ord ORDER BY patch_id) - 1 AS n, total FROM (SELECT patch_id, slide_ord, CAST(sum(r + g + b) AS BIGINT) AS total FROM vpx GROUP BY patch_id, slide_ord))
SELECT patch_id, 8 * (n % 16) AS x, 8 * (n // 16) AS y, total FROM n""")(decoded)

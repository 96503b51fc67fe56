"""Virtual slides, pyramid levels, regions, points, features and patches derived from the test tables, and the same as SQL.

They stand in for image files where only the relational part of a plan is of interest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidemill.operators.tiles import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mpp = F.when(F.col("p_partkey") % 3 == 0, 0.25).when(F.col("p_partkey") % 3 == 1, 0.5).otherwise(0.2425)
    return p.select(
        F.col("p_partkey").alias("slide_ord"), F.concat(F.lit("slide_"), "p_partkey").alias("wsi_id"),
        (2000 + (F.col("p_partkey") * 37) % 3000).cast("long").alias("w"), (1500 + F.col("p_size") * 50).cast("long").alias("h"), mpp.alias("mpp0"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(d).alias("ds")) for i, d in enumerate((1.0, 2.0, 4.0, 8.0))])
    odd = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(d).alias("ds")) for i, d in enumerate((1.0, 4.0, 16.0))])
    s = slides(spark, sf_dir).withColumn("l", F.explode(F.when(F.col("slide_ord") % 2 == 0, even).otherwise(odd))).select("*", "l.level", "l.ds").drop("l")
    return s.select("slide_ord", "level", "ds", F.floor(F.col("w") / F.col("ds")).alias("lw"), F.floor(F.col("h") / F.col("ds")).alias("lh"), "mpp0")


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each line number that a part's line items have, over all of them."""
    s = slides(spark, sf_dir).withColumnsRenamed({"w": "sw", "h": "sh"})
    o = table(spark, sf_dir, "lineitem")
    j = o.join(s, o.l_partkey == s.slide_ord)
    half = lambda c: F.floor(F.col(c) / 2)
    r = j.groupBy("slide_ord", "wsi_id", "sw", "sh", "l_linenumber").agg(
        F.min((F.col("l_orderkey") * 131) % half("sw")).alias("x"), F.min((F.col("l_orderkey") * 197 + F.col("l_linenumber") * 53) % half("sh")).alias("y"),
        (100 + (F.sum("l_quantity").cast("long") * 7) % 400).alias("w"), (100 + (F.sum("l_suppkey") * 173) % 400).alias("h"),
    )
    r = dealt(r, s.count())
    index = (F.row_number().over(Window.partitionBy("slide_ord").orderBy("l_linenumber")) - 1).cast("long")
    return r.select("slide_ord", "wsi_id", "sw", "sh", index.alias("roi_index"), "x", "y", F.least("w", F.col("sw") - F.col("x")).alias("w"), F.least("h", F.col("sh") - F.col("y")).alias("h"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = slides(spark, sf_dir), table(spark, sf_dir, "lineitem")
    return o.join(s, o.l_partkey == s.slide_ord).select(
        "slide_ord", ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % F.col("w")).alias("px"),
        ((F.col("l_suppkey") * 6151 + F.col("l_orderkey") * 31) % F.col("h")).alias("py"), F.col("l_linenumber").cast("int").alias("label"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square polygons of four vertices in level-0 pixels: a row for each vertex."""
    s, e = slides(spark, sf_dir), table(spark, sf_dir, "events")
    f = e.join(s, e.user_id == s.slide_ord).select(
        "slide_ord", F.col("event_id").alias("fid"), ((F.col("event_id") * 613) % F.col("w")).alias("cx"), ((F.col("event_id") * 389 + F.col("user_id")) % F.col("h")).alias("cy"),
        (1 + F.col("event_id") % 5).alias("half"), F.col("event_type").alias("celltype"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    corner = lambda a, b: F.struct((F.col("cx") + a * F.col("half")).cast("double").alias("vx"), (F.col("cy") + b * F.col("half")).cast("double").alias("vy"))
    v = f.withColumn("v", F.explode(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))))
    return v.select("slide_ord", "fid", "celltype", "k", "v.vx", "v.vy")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, slide_ord, i and r, g, b of 8 x 8 patches: a row for each pixel."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), F.col("label").alias("slide_ord"), "embedding")
    value = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.bround((k.cast("double") + 0.6) * 200, 0).cast("int")))
    at = lambda i, off: F.get("embedding", (i + off) % 64)
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("i"), value(at(i, 0)).alias("r"), value(at(i, 21)).alias("g"), value(at(i, 43)).alias("b")))
    return e.select("patch_id", "slide_ord", F.explode(px).alias("p")).select("patch_id", "slide_ord", "p.*")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patches as rows of packed pixels with their place: patch_id, slide_ord, x, y, pixels, ph, pw, pc."""
    n = F.row_number().over(Window.partitionBy("slide_ord").orderBy("patch_id")) - 1
    px = pixels(spark, sf_dir).groupBy("patch_id", "slide_ord").agg(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b"))).alias("p"))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    packed = F.unhex(F.array_join(F.transform("p", lambda q: F.concat(byte(q["r"]), byte(q["g"]), byte(q["b"]))), ""))
    out = px.select("patch_id", "slide_ord", packed.alias("pixels"), F.lit(8).alias("ph"), F.lit(8).alias("pw"), F.lit(3).alias("pc")).withColumn("n", n)
    return out.select("patch_id", "slide_ord", (8 * (F.col("n") % 16)).cast("long").alias("x"), (8 * F.floor(F.col("n") / 16)).cast("long").alias("y"), "pixels", "ph", "pw", "pc")


SQL = {
    "vslide": """vslide AS (SELECT p_partkey AS slide_ord, 'slide_' || p_partkey AS wsi_id, CAST(2000 + (p_partkey * 37) % 3000 AS BIGINT) AS w, CAST(1500 + p_size * 50 AS BIGINT) AS h,
  CASE p_partkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.2425 END::DOUBLE AS mpp0 FROM part)""",
    "vlevel": """vlevel AS (SELECT slide_ord, level, ds, CAST(floor(w / ds) AS BIGINT) AS lw, CAST(floor(h / ds) AS BIGINT) AS lh, mpp0
  FROM vslide JOIN (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0), (0, 2, 4.0), (0, 3, 8.0), (1, 0, 1.0), (1, 1, 4.0), (1, 2, 16.0)) AS l(par, level, ds) ON l.par = slide_ord % 2)""",
    "vroi": """vroi AS (SELECT slide_ord, wsi_id, sw, sh, row_number() OVER (PARTITION BY slide_ord ORDER BY l_linenumber) - 1 AS roi_index, x, y, least(w, sw - x) AS w, least(h, sh - y) AS h FROM (
  SELECT s.slide_ord, s.wsi_id, s.w AS sw, s.h AS sh, o.l_linenumber, min((o.l_orderkey * 131) % (s.w // 2)) AS x, min((o.l_orderkey * 197 + o.l_linenumber * 53) % (s.h // 2)) AS y,
    100 + (CAST(sum(o.l_quantity) AS BIGINT) * 7) % 400 AS w, 100 + CAST((sum(o.l_suppkey) * 173) % 400 AS BIGINT) AS h
  FROM lineitem o JOIN vslide s ON o.l_partkey = s.slide_ord GROUP BY s.slide_ord, s.wsi_id, s.w, s.h, o.l_linenumber))""",
    "vpoint": """vpoint AS (SELECT s.slide_ord, (o.l_orderkey * 7919 + o.l_linenumber * 104729) % s.w AS px, (o.l_suppkey * 6151 + o.l_orderkey * 31) % s.h AS py, CAST(o.l_linenumber AS INT) AS label
  FROM lineitem o JOIN vslide s ON o.l_partkey = s.slide_ord)""",
    "vfeature": """vfeature AS (SELECT s.slide_ord, e.event_id AS fid, CAST((e.event_id * 613) % s.w AS DOUBLE) AS cx, CAST((e.event_id * 389 + e.user_id) % s.h AS DOUBLE) AS cy,
  1 + e.event_id % 5 AS half, e.event_type AS celltype, CAST(json_extract(e.props, '$.k') AS INT) AS k FROM events e JOIN vslide s ON e.user_id = s.slide_ord)""",
    "vpx": """vpx AS (SELECT vec_id AS patch_id, label AS slide_ord, i,
  least(255, greatest(0, CAST(round_even((CAST(embedding[i + 1] AS DOUBLE) + 0.6) * 200, 0) AS INT))) AS r,
  least(255, greatest(0, CAST(round_even((CAST(embedding[(i + 21) % 64 + 1] AS DOUBLE) + 0.6) * 200, 0) AS INT))) AS g,
  least(255, greatest(0, CAST(round_even((CAST(embedding[(i + 43) % 64 + 1] AS DOUBLE) + 0.6) * 200, 0) AS INT))) AS b
  FROM embeddings, range(0, 64) t(i))""",
}


def with_views(*names: str) -> str:
    """WITH clause of the named views and those they stand on."""
    need = {"vlevel": ["vslide"], "vroi": ["vslide"], "vpoint": ["vslide"], "vfeature": ["vslide"]}
    out = list(dict.fromkeys(v for n in names for v in [*need.get(n, []), n]))
    return "WITH " + ",\n".join(SQL[n] for n in out)

"""Places in a global order, and what tasks have to do for them."""

import pytest
from pyspark.sql import functions as F

from slidemill.operators import rois, shards, tiles


@pytest.mark.parametrize("n", [0, 1, 7, 64, 300])
def test_places_among_cuts(spark, n):
    cuts = [f"k{10 * i:05}" for i in range(n)]
    rows = spark.range(3200).select(F.format_string("k%05d", "id").alias("_first")).unionByName(spark.createDataFrame([(None,), ("",), ("z",)], "_first string"))
    for r in shards._placed(rows, cuts).collect():
        assert r._bucket == sum(r._first is not None and c <= r._first for c in cuts)


def test_ranges_grow_with_rows(spark, monkeypatch):
    """The number of ranges that a caller gives is the least; no range holds many more rows than one task should order."""
    monkeypatch.setattr(shards, "RANGE", 100)
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") * 7919 % 5000).alias("key"))
    tagged = rows.withColumn("_first", F.col("key"))
    cuts = shards._cuts(tagged, 8)
    assert shards._placed(tagged, cuts).groupBy("_bucket").count().agg(F.max("count")).first()[0] < 300
    got = shards.assign_shards(rows, 30, [F.col("key")], ranges=8).collect()
    assert [r.key for r in sorted(got, key=lambda r: r.idx)] == sorted(f"k{i}" for i in range(5000))
    assert sorted(r.idx for r in got) == list(range(5000)) and all(r.shard_id == r.idx // 30 for r in got)


def test_tiles_are_made_by_many_tasks(spark):
    slides = spark.range(1000).select(F.col("id").alias("slide_ord"), F.lit("a").alias("wsi_id"), F.lit(1000).cast("long").alias("w"), F.lit(1000).cast("long").alias("h"))
    whole = rois.attach_rois(slides, [rois.whole_slides(slides)])
    made = tiles.plan_tiles(tiles.dealt(whole, 1000, each=50), 500, 500).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in made) == 4000 and max(r.n for r in made) < 500

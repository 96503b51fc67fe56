"""Slides are told by prefixes of keys before their tiles are made."""

import pytest
from pyspark.sql import functions as F

from slidemill.operators import shards


@pytest.mark.parametrize("prefixes,slides", [(["s_1_"], 1), (["s_1"], 111), (["s_12_3", "s_40_"], 2), (["s_12_30_4", "t"], 1), ([""], 1000), ([], 1000), (["s_"], 1000), (["s_1_9_9_9"], 1)])
def test_no_wanted_slide_is_left_out(spark, prefixes, slides):
    stems = spark.range(1000).select(F.concat(F.lit("s_"), "id").alias("stem"))
    keys = lambda df: df.crossJoin(spark.range(40).toDF("x")).select(F.concat_ws("_", "stem", "x", F.col("x") % 5).alias("key"))
    some = stems.filter(shards.may_start(F.concat("stem", F.lit("_")), prefixes))
    assert some.count() == slides
    assert sorted(shards.keep_prefixes(keys(some), prefixes).collect()) == sorted(shards.keep_prefixes(keys(stems), prefixes).collect())

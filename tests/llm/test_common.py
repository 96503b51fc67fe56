import os

from pyspark.sql import functions as F

from slidemill.llm import common


def test_pick_by_exact_name(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").select("doc_id", "text", F.lit("b").alias("TEXT"), F.lit(9).alias("Doc_ID"), F.lit("c").alias("text"))
    assert tuple(common.pick(df, doc_id="long", text="string", lang="string").first()) == (1, "a", None)


def test_settle_and_release(spark):
    out = common.settle(spark.range(5), "five")
    at = common._settled[-1]
    assert out.count() == 5 and os.path.isdir(at.removeprefix("file:"))
    common.release(spark)
    assert not os.path.exists(at.removeprefix("file:")) and common._settled == []


def test_crc_mod(spark):
    import zlib

    df = spark.createDataFrame([(1,), (-7,), (None,)], "i long")
    assert [r[0] for r in df.select(common.crc_mod(F.col("i"), 7)).collect()] == [zlib.crc32(b"1") % 7, zlib.crc32(b"-7") % 7, 0]


def test_settle_large_rows(spark):
    """Workers get so many rows at once and no more, for this table alone; large rows are not written by Snappy, which holds whole pages outside the heap."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    before = spark.conf.get(common.AT_ONCE)

    def sizes(batches):
        for b in batches:
            yield b.assign(n=len(b), blob=b["id"].map(lambda i: os.urandom(300_000)))

    out = common.settle(spark.range(0, 40, 1, 1).mapInPandas(sizes, "id long, n long, blob binary"), "large", 7, large=True)
    assert out.count() == 40 and out.agg(F.max("n")).first()[0] == 7 and spark.conf.get(common.AT_ONCE) == before
    file = next(f for f in ds.dataset(common._settled[-1].removeprefix("file:")).files)
    column = pq.ParquetFile(file).metadata.row_group(0).column(2)
    assert column.compression == "ZSTD"
    common.release(spark)


def test_freed_memory_is_given_back():
    """Small pieces that are freed between others that stay."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    pieces = [bytes([i % 256]) * 3000 for i in range(100_000)]
    stay = pieces[::50]
    del pieces
    most = held()
    common.give_back()
    assert len(stay) == 2000 and (most - held() > 100_000_000 or held() < 200_000_000)

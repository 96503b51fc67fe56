import pytest
from pyspark.sql import functions as F

from slidemill.llm import urls

CASES = [
    ("https://WWW.Example.com/en/1?a=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/2", "m.example.com", "/en/2", "example.com/en/", "block"),
    ("http://example.com/fr/", "example.com", "/fr/", "com/", "allow"),
    ("http://notexample.com", "notexample.com", "", None, "allow"),
    ("ftp://a.net/es/x#f", "a.net", "/es/x", "net/es/", "block"),
    ("http://anet/es/x", "anet", "/es/x", None, "allow"),
    ("http://h.org/p//?utm_source=x&b=2&a=1#z", "h.org", "/p//", None, "block"),
    ("http://h.org/p?a=1", "h.org", "/p", None, "allow"),
    ("x", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.mark.parametrize("broadcast", [urls.BROADCAST, 0])
def test_cases(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST", broadcast)
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(0, CASES[0][0]), (None, "http://q.org/" + "y" * 100_000)], "page_id long, url string").select("*", F.lit(1).alias("URL"), F.lit(2).alias("block"))
    listed = spark.createDataFrame([("https://h.org/p?a=1&b=2&ref=9",), (None,), ("",), ("zzz",), ("https://h.org/p?b=2&a=1",)], "url string")
    out = urls.filter_urls(pages, listed).collect()
    got = {r.page_id: tuple(r)[1:5] for r in out if r.page_id is not None}
    assert len(out) == len(CASES) + 2 and got == {i: c[1:] for i, c in enumerate(CASES)}
    assert urls.filter_urls(pages.limit(0), listed).count() == 0
    assert not any(r.listed for r in urls.filter_urls(pages, listed.limit(0)).collect())


def test_filter_passes_all_listed(spark):
    many = spark.range(3000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    assert urls.filter_urls(pages, many).filter("verdict = 'block'").agg(F.count("*"), F.max("page_id")).first() == (3000, 2999)

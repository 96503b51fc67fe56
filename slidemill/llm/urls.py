"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import pick

#: The rules of the query, as verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that do not change what a URL shows.
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")
#: Bits of the filter for each listed URL, and of a block: eight words of 64, in each of which a URL sets one bit.
BITS, WORDS, WORD = 16, 8, 64
#: Listed URLs up to which the filter (72 bytes a block, 2.4 MB at most) and the list are broadcast.
BROADCAST = 1_000_000


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without the slash at its end, and sorted parameters without tracking ones; no scheme, no fragment; empty where there is no host."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~_any(p.startswith(t) for t in TRACKING)))
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.coalesce(F.concat(host_of(url), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")), F.lit(""))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null. rules is a short list of settings, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rh) | host.endswith("." + rh)) & path.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(url: Column) -> list[Column]:
    second = F.xxhash64(url, F.lit(1))
    return [F.shiftright(second, 6 * i).bitwiseAND(WORD - 1).cast("int") for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of column url: block and words w0 to w7; a block that no URL falls in has no row."""
    one = F.lit(1).cast("long")
    words = [F.bit_or(F.call_function("shiftleft", one, b)).alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))]
    return listed.groupBy(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block")).agg(*words)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every row of pages(page_id, url) by the rules, and what no rule fits by the list of URLs in listed(url).

    Gives page_id, host, path, rule, verdict, canonical_url, listed. The list is compared by canonical URL.
    URLs that are null or have no `://` have empty host, path and canonical URL, fit no rule and are allowed;
    empty or null list entries list nothing. Repeated rows and null ids are kept; repeated list entries count
    once; empty tables give an empty result or an empty list. The filter and the list are broadcast up to
    BROADCAST entries, counted first; longer ones are joined by shuffle, where only possible hits share keys.
    """
    urls = pick(listed, url="string").select(canonical(F.col("url")).alias("url")).filter("url <> ''").distinct()
    n = urls.count()
    blocks = max(1, -(-n * BITS // (WORDS * WORD)))
    dealt = (lambda df: F.broadcast(df)) if n <= BROADCAST else (lambda df: df)

    rows = pick(pages, page_id="long", url="string").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "canonical_url": canonical(F.col("url"))})
    rows = rows.withColumns({"judged": rule_for(F.col("host"), F.col("path"), rules), "block": F.pmod(F.xxhash64("canonical_url"), F.lit(blocks))})
    probed = rows.join(dealt(bloom(urls, blocks)), "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("canonical_url"))):
        hit = hit & (F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1)
    probed = probed.withColumn("possible", F.coalesce(hit, F.lit(False)) & (F.col("canonical_url") != ""))
    exact = urls.select(F.col("url").alias("canonical_url"), F.lit(True).alias("possible"), F.lit(True).alias("found"))
    out = probed.join(dealt(exact), ["canonical_url", "possible"], "left")
    out = out.withColumn("listed", F.coalesce("found", F.lit(False)))
    verdict = F.coalesce("judged.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), verdict.alias("verdict"), "canonical_url", "listed")


#: What the query computes, with an exact join in place of the filter.
SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')
           AND NOT starts_with(x, 'ref=') AND NOT starts_with(x, 'fbclid=') AND NOT starts_with(x, 'gclid='))) AS args
  FROM p
), c AS (
  SELECT page_id, host, path, host || regexp_replace(path, '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical_url FROM q
), r(verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), j AS (
  SELECT c.*, (SELECT max_by(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
         canonical_url <> '' AND canonical_url IN (SELECT canonical_url FROM c WHERE page_id % 100 = 0) AS listed
  FROM c
)
SELECT page_id, host, path, j.rule, coalesce(r.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, canonical_url, listed
FROM j LEFT JOIN r ON r.rh || r.rp = j.rule
"""

"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document is far longer than a benchmark item, so what matters is containment: the share of the item's
shingles that the document holds. Items are partitioned by size (powers of two). If an item of at most u
shingles is contained to the threshold t, at most u - ceil(t u) of its shingles are missing, so of any one more
than that many at least one is in the document. Each partition keeps that many of the smallest min-hash values
of each item as its signature: every document that reaches the threshold shares one, none is lost, and the
signature grows with the partition's size bound. Shared values make candidates; these are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import pick, row_hash, settle, small_enough

SHINGLE = 5
THRESHOLD = 0.8
#: Signature values searched for in one pass over the documents (an item has five shingles for each at most, and each value and shingle is broadcast once, so that is bounded too); larger benchmarks take more passes.
PASS = 50_000
#: Candidate pairs of a document and an item up to which they are broadcast (about 30 MB) and no text is shuffled.
PAIRS = 1_000_000
GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; the first or last is empty where the text begins or ends otherwise."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)


def _shingle_hash(h: str, x: str = "x", i: str = "i") -> str:
    """SQL of the hash of the five words from place i on; at the last four places, of those left, which equals that of no five."""
    return f"xxhash64({x}, " + ", ".join(f"get({h}, {i} + {k})" for k in range(1, SHINGLE)) + ")"


def shingles(w: str = "w") -> Column:
    """The distinct five-word shingles of a column of words as text; fewer words make none. Words are taken by place: a slice of the array would copy it whole for each shingle."""
    five = f"concat_ws(' ', x, {', '.join(f'get({w}, i + {k})' for k in range(1, SHINGLE))})"
    return F.array_distinct(F.expr(f"slice(transform({w}, (x, i) -> {five}), 1, greatest(size({w}) - {SHINGLE - 1}, 0))"))


def signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item, item_id, n, parts, of each item with five words or more; sig: its smallest min-hash values, as many as its size partition needs."""
    rows = pick(items, item_id="long", text="string").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    # the filter is on the words, not on what is made of them: it is pushed down and would work out all words again for each shingle
    rows = rows.withColumn("w", F.filter(words(F.col("text")), lambda x: x != "")).filter(F.size("w") >= SHINGLE).withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("h", F.array_distinct(F.expr(f"slice(transform(h1, (x, i) -> {_shingle_hash('h1')}), 1, greatest(size(w) - {SHINGLE - 1}, 0))")))
    rows = rows.select("item", "item_id", shingles().alias("parts"), "h").withColumn("n", F.size("parts"))
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    keep = (bound - F.ceil(bound * threshold - 1e-9) + 1).cast("int")
    ranked = F.slice(F.array_sort(F.transform("h", lambda x: F.struct(F.xxhash64(x, F.lit(7)).alias("min"), x.alias("h")))), 1, keep)
    return rows.select("item", "item_id", "n", "parts", F.transform(ranked, lambda s: s["h"]).alias("sig"))


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of docs(text), item_id, n_shingles, n_shared, containment for each row and item contained to the threshold.

    Distinct five-word shingles of lower-cased runs of letters and digits count. Items with fewer words,
    null or empty items and null, empty or shorter documents match nothing. Repeated documents are each
    reported, equal items once. Empty tables give an empty result. Each pass searches for about PASS signature values,
    whatever the size of the benchmark. What shares one is a candidate, a pair of two numbers; no text goes with them, and
    documents are read where they lie again to verify them, or shuffled where over PAIRS have candidates.
    """
    known = settle(signatures(items, threshold), "signatures")
    total = known.agg(F.coalesce(F.sum(F.size("sig")), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS))
    out = None
    for k in range(passes):
        own = known.filter(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(passes)) == k)
        values = [v for (v,) in own.select(F.explode("sig")).distinct().collect()]
        part = _one_pass(docs, own, values, threshold, carry)
        out = part if out is None else out.unionByName(part)
    return out


def _one_pass(docs: DataFrame, items: DataFrame, values: list[int], threshold: float, carry: tuple[str, ...]) -> DataFrame:
    listed = ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) or "NULL"
    held = docs.select(*carry, F.col("text").alias("words_of"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in carry], "text").alias("place"))
    rows = held.select("place", words(F.col("words_of")).alias("w")).withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("at", F.expr(f"filter(transform(h1, (x, i) -> {_shingle_hash('h1')}), x -> x IN ({listed}))"))
    # explode_outer and a filter above it: a filter on the array itself would be pushed below the projections and work them out again for each place
    rows = rows.withColumn("shared", F.array_distinct("at")).select("place", F.explode_outer("shared").alias("value")).filter("value IS NOT NULL")
    pairs = settle(rows.join(F.broadcast(items.select("item", F.explode("sig").alias("value"))), "value").select("place", "item").distinct(), "candidates")
    small = F.broadcast if small_enough(pairs, PAIRS) else lambda df: df.hint("merge")
    found = held.join(small(pairs), "place").withColumn("w", words(F.col("words_of")))
    found = found.join(F.broadcast(items.select("item", "item_id", "n", "parts")), "item")
    found = found.withColumn("n_shared", F.size(F.array_intersect(shingles(), "parts")))
    found = found.withColumn("containment", F.col("n_shared") / F.col("n")).filter(F.col("containment") >= threshold - 1e-9)
    return found.select(*carry, "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), "containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that contain no item to the threshold."""
    names = docs.columns
    bare = docs.toDF(*[f"c{i}" for i in range(len(names))])
    bare = bare.withColumns({"key": F.col(f"c{names.index('doc_id')}").cast("long"), "row": row_hash(bare), "text": F.col(f"c{names.index('text')}").cast("string")})
    hits = settle(find(bare, items, threshold, carry=("key", "row")).select("key", "row").distinct(), "hits").alias("b")
    left = bare.alias("a").join(hits, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.row") == F.col("b.row")), "left_anti")
    return left.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """find() over docs(doc_id, text), other columns ignored whatever their names."""
    return find(pick(docs, doc_id="long", text="string"), items, threshold)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, text FROM benchmark
), i AS (
  SELECT item_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM b
), ds AS (
  SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(list_slice(w, k, k + 4), ' '))) AS s FROM d
), bs AS (
  SELECT DISTINCT item_id, text, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(list_slice(w, k, k + 4), ' '))) AS s FROM i
), n AS (
  SELECT item_id, text, count(*) AS n_shingles FROM bs GROUP BY ALL
), m AS (
  SELECT ds.r, ds.doc_id, bs.item_id, bs.text, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL
)
SELECT doc_id, m.item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n ON m.item_id IS NOT DISTINCT FROM n.item_id AND m.text = n.text WHERE n_shared / n_shingles >= 0.8 - 1e-9
"""

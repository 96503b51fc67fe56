"""Document fingerprints: SimHash as a plain column expression, and Hamming search over permuted block tables.

A document's terms are its pairs of neighbouring words (a single word stands for itself), hashed by XXH64 and
weighted by how often they occur. Each occurrence votes on 64 signed bits. Votes are summed in lanes of 21
bits, three to a long, so 21 sums and one for the last bit hold them all.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.common import SPACE, pick, settle, small_enough

LANE = 21
LANES = (1 << 0) | (1 << LANE) | (1 << 2 * LANE)
#: Terms that a lane can count; beyond, the bits are counted one by one.
MOST = (1 << LANE) - 1
#: Ranges of ids between percentiles, at most, and percentiles within each of them, at most (fewer than 2,048): 16 MB of numbers where all are needed.
RANGES = 2_000
STEPS = 1_000
EDGES = " \t\n\x0b\x0c\r"


def term_hashes(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words of the lower-cased text, in order, repeats included."""
    words = F.split(F.btrim(F.lower(text), F.lit(EDGES)), SPACE)
    each = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.coalesce(each, F.array().cast("array<bigint>"))


def pairs(each: Column) -> Column:
    n = F.size(each)
    zipped = F.zip_with(F.slice(each, 1, F.greatest(n - 1, F.lit(0))), F.slice(each, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 2, each).otherwise(zipped)


def _sum(terms: Column, of) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda total, x: total + of(x))


def votes(terms: Column) -> list[Column]:
    """Lane sums of the terms."""
    lane = lambda k: lambda x: F.shiftrightunsigned(x, k).bitwiseAND(F.lit(LANES))
    return [_sum(terms, lane(k)) for k in range(LANE)] + [_sum(terms, lambda x: F.shiftrightunsigned(x, 63))]


def decide(sums: list[Column], n: Column) -> Column:
    """The fingerprint: a bit is set if over half of the n terms set it."""
    out = F.lit(0).cast("long")
    for b in range(64):
        count = sums[LANE] if b == 63 else F.shiftrightunsigned(sums[b % LANE], LANE * (b // LANE)).bitwiseAND((1 << LANE) - 1)
        out = out.bitwiseOR(F.when(count * 2 > n, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return out


def decide_long(terms: Column, n: Column) -> Column:
    """The same for any number of terms, bit by bit."""
    bit = lambda b: F.aggregate(terms, F.lit(0).cast("long"), lambda t, x: t + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1)))
    marks = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(bit(b) * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def with_fingerprints(df: DataFrame, **columns: str) -> DataFrame:
    """df with a signed 64-bit fingerprint column for each text column: with_fingerprints(df, fp="text").

    Null, empty and white-space texts have fingerprint zero. Each step is its own projection, so that no
    expression is worked out twice.
    """
    names = df.columns
    for out, text in columns.items():
        df = df.withColumn(f"{out}__each", term_hashes(F.col(text)))
    for out in columns:
        df = df.withColumn(f"{out}__terms", pairs(F.col(f"{out}__each"))).drop(f"{out}__each")
    for out in columns:
        terms = F.col(f"{out}__terms")
        short = F.when(F.size(terms) <= MOST, terms).otherwise(F.array().cast("array<bigint>"))
        df = df.withColumn(f"{out}__short", short)
        df = df.withColumns({f"{out}__v{i}": v for i, v in enumerate(votes(F.col(f"{out}__short")))})
        n = F.size(terms)
        df = df.withColumn(out, F.when(n > MOST, decide_long(terms, n)).otherwise(decide([F.col(f"{out}__v{i}") for i in range(LANE + 1)], n)))
        df = df.select(*[c for c in df.columns if not c.startswith((f"{out}__v", f"{out}__short"))])
    return df.select(*names, *columns)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def ranged(rows: DataFrame, per_range: int) -> DataFrame:
    """rows(doc_id, text) with a range (cut, step): ascending in the order of doc_id (null first), hash of the text; about per_range rows each.

    Percentiles of doc_id cut the rows RANGES times at most, and percentiles within each cut cut it on, STEPS times at most,
    so how the ids lie makes no difference. Beyond RANGES * STEPS * per_range rows ranges grow. An id that
    fills whole percentiles, or null, is dealt by the hash of its texts, which comes second in the order.
    """
    n, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    parts = max(1, min(RANGES, -(-known // per_range)))
    steps = max(1, min(STEPS, -(-known // (parts * per_range))))
    cuts = rows.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)] + [1.0], 20 * parts)).first()[0] if known else [0, 0]
    times = {x: cuts.count(x) for x in cuts}
    heavy = {x: k * steps for x, k in times.items() if k > 1 and parts > 1}
    cut = _range_of(F.col("doc_id"), sorted(times)) - 1
    by_hash = lambda k: F.floor((F.col("hash").cast("double") / float(1 << 64) + 0.5) * k)
    many = F.lit(0)
    for x, k in heavy.items():
        many = F.when(F.col("doc_id") == x, F.lit(k)).otherwise(many)
    spread = max([*heavy.values(), 1])
    rows = rows.withColumns({"hash": F.xxhash64("text"), "heavy": many, "cut": F.when(F.col("doc_id").isNull(), F.lit(-2)).otherwise(cut).cast("int")})
    within = F.lit(0)
    if steps > 1:
        # edges: percentiles of the cut's other ids, RANGES * STEPS numbers at most; where one fills several, its rows are dealt by hash before those of larger ids
        edges = rows.filter("doc_id is not null and heavy = 0").groupBy("cut").agg(F.percentile_approx("doc_id", [i / steps for i in range(steps)] + [1.0], 20 * steps).alias("edges"))
        rows = rows.join(F.broadcast(settle(edges, "range-edges")), "cut", "left")
        at = _places(F.col("edges"), F.col("doc_id"))
        rows = rows.withColumn("at", at).withColumn("below", _places(F.col("edges"), F.col("doc_id") - 1))
        own = F.when(F.col("at") - F.col("below") > 1, by_hash(F.col("at") - F.col("below"))).otherwise(F.lit(STEPS + 1))
        within = F.col("at") * (STEPS + 2) + own
    step = F.when(F.col("doc_id").isNull(), by_hash(max(1, -(-(n - known) // per_range)))).when(F.col("heavy") > 0, by_hash(F.col("heavy"))).otherwise(within + spread)
    return rows.withColumn("step", step.cast("long")).drop("heavy", "edges", "at", "below")


def _places(edges: Column, id_: Column) -> Column:
    """How many of the ascending numbers edges, fewer than 2,048, are at or below the id: by halving, as a fold over powers of two."""
    halves = F.array(*[F.lit(1 << k) for k in range(10, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda found, k: F.when(F.coalesce(F.get(edges, found + k - 1) <= id_, F.lit(False)), found + k).otherwise(found))


def edited_documents(docs: DataFrame, per_range: int = 2000, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within, least_within of every row of docs(doc_id, text).

    The edited text has the last floor(n_chars / 4) code points replaced by as many (or all) of the first
    of the next document in ascending doc_id, after the last the first. Null texts count as empty. Rows of
    one doc_id follow each other by the hash of the text, then by the text; null ids come first. A table of one row is its own next; an empty
    table gives an empty result; other columns are ignored whatever their names.

    Rows whose doc_id is divisible by 100 also ask which fingerprints of all rows are within the radius:
    n_within is how many rows have one (the row itself included), least_within their smallest doc_id. For other rows both are null.

    Rows are dealt once, into ranges of doc_id of about per_range rows; the next of a
    range's last row is the first row of the next range, found among the ranges' first rows alone.
    """
    rows = ranged(pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))), per_range)
    own = Window.partitionBy("cut", "step").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text")
    after = with_fingerprints(rows, fp="text").withColumns({"next_text": F.lead("text").over(own), "next_fp": F.lead("fp").over(own)})

    # the first row of each range is the next of the range before it: ranges of one cut, then cuts, in order
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")
    firsts = settle(rows.groupBy("cut", "step").agg(F.min(place).alias("first")), "range-firsts")
    within = firsts.withColumn("next", F.lead("first").over(Window.partitionBy("cut").orderBy("step")))
    heads = firsts.groupBy("cut").agg(F.min_by("first", "step").alias("head"))
    heads = heads.select("cut", F.coalesce(F.lead("head").over(Window.orderBy("cut")), F.first("head").over(Window.orderBy("cut"))).alias("head"))  # RANGES + 2 rows at most
    nexts = within.join(F.broadcast(heads), "cut").select("cut", "step", F.coalesce("next", "head").alias("first"))
    asked = nexts.select(F.col("first.doc_id").alias("doc_id"), F.col("first.known").alias("known"), F.col("first.hash").alias("hash"), F.col("cut").alias("for_cut"), F.col("step").alias("for_step"))
    found = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "hash", "text")
    asked = asked.withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    hint = F.broadcast if small_enough(asked, QUERIES) else lambda df: df
    found = found.join(hint(asked), ["id", "known", "hash"])
    first_texts = with_fingerprints(found.groupBy(F.col("for_cut").alias("cut"), F.col("for_step").alias("step")).agg(F.min("text").alias("head_text")), head_fp="head_text")
    after = after.join(first_texts, ["cut", "step"], "left").withColumns({"next_text": F.when(F.col("next_fp").isNull(), F.col("head_text")).otherwise(F.col("next_text")), "next_fp": F.coalesce("next_fp", "head_fp")})

    q = F.floor(F.length("text") / 4).cast("int")
    edited = after.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - q), F.substring("next_text", F.lit(1), q)))
    edited = with_fingerprints(edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", "edited"), efp="edited")
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    edited = settle(edited.select("doc_id", "n_chars", sha, "fp", "efp", "next_fp"), "edited")

    fps = edited.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    asks = F.col("doc_id") % 100 == 0
    met = within_radius(edited.filter(asks).select("fp"), fps, radius).join(fps, "fp").groupBy("query_fp").agg(F.sum("n").alias("n_within"), F.min("least").alias("least_within"))
    none = F.lit(None).cast("long")
    out = edited.filter(asks).join(met, F.col("fp") == F.col("query_fp"), "left").drop("query_fp")
    out = out.unionByName(edited.filter(~F.coalesce(asks, F.lit(False))).withColumns({"n_within": none, "least_within": none}))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within", "least_within",
    )


def _range_of(id_: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the id, by halving: a balanced tree of comparisons."""

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(id_ < cuts[mid], find(lo, mid)).otherwise(find(mid + 1, hi))

    return find(0, len(cuts))


def permuted_blocks(fp: Column, radius: int, blocks: int) -> Column:
    """Array of keys, one for each choice of blocks - radius blocks of bits: fingerprints within the radius share one at least."""
    if not 0 <= radius < blocks <= 16:
        raise ValueError("need 0 <= radius < blocks <= 16")
    ends = [64 * i // blocks for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned(fp, ends[i]).bitwiseAND((1 << (ends[i + 1] - ends[i])) - 1)
    return F.array(*[F.struct(F.lit(k).alias("table"), F.xxhash64(*[part(i) for i in chosen]).alias("bits")) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))])


#: Query fingerprints up to which their block tables are broadcast.
QUERIES = 100_000
#: Queries of one key up to which its fingerprints are not dealt out.
CROWD = 100


def blocks_for(n_queries: int, radius: int) -> int:
    """Blocks whose keys have at least as many values as there are queries: what a fingerprint meets by chance is bounded by its number of keys, however many queries there are."""
    return next((b for b in range(radius + 2, 16) if 64 * (b - radius) // b >= n_queries.bit_length()), 16)


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """query_fp, fp, distance for all fingerprints fps(fp) within the radius of each distinct query fingerprint queries(fp), itself included.

    Distinct fingerprints meet in a table for each choice of blocks and are compared in full. Nulls find nothing.
    blocks: by the number of queries if not given. Where queries are too many to broadcast, the fingerprints of a key
    that over CROWD queries have are dealt by hash into parts, and its queries go to each part.
    """
    settled = settle(queries.select(F.col("fp").cast("long").alias("fp")).filter("fp is not null").distinct(), "radius-queries")
    n = settled.count()
    blocks = blocks_for(n, radius) if blocks is None else blocks
    keyed = lambda df, name: df.select(F.col("fp").cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct().select(name, F.explode(permuted_blocks(F.col(name), radius, blocks)).alias("key"))
    asked, known, on = keyed(settled, "query_fp"), keyed(fps, "fp"), ["key"]
    if n <= QUERIES:
        asked = F.broadcast(asked)
    else:
        crowds = settle(asked.groupBy("key").agg(F.ceil(F.count("*") / CROWD).alias("parts")).filter("parts > 1"), "crowds")
        crowds = F.broadcast(crowds) if small_enough(crowds, QUERIES) else crowds
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        known = known.join(crowds, "key", "left").withColumn("part", F.pmod(F.xxhash64("fp"), parts)).drop("parts")
        asked = asked.join(crowds, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts").hint("merge")
        on = ["key", "part"]
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))).cast("int")
    return known.join(asked, on).withColumn("distance", distance).filter(F.col("distance") <= radius).select("query_fp", "fp", "distance").distinct()

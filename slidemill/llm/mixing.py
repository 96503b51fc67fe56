"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Source weights are token shares to the power alpha, normalised. Alpha is bisected for the largest one whose
weights have the target entropy at least, or, for a repetition limit, for the smallest one at which no source
is drawn more often than the limit. A budget of tokens is dealt to the sources by these weights. Each source's
documents fall into blocks by a hash; every pass over the source draws its blocks in an order of its own and
the last pass ends within a block, whose documents are drawn in hash order until the source's budget is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.common import pick, settle, small_enough

#: Documents that a block has on average; the blocks of a source grow with it.
BLOCK = 500
#: Blocks of a source at most: beyond, blocks are larger, so neither a source's blocks nor a block's rows are too many to put in order.
BLOCKS = 65_536
#: Times that a row may be drawn, at most: its turns are an array of so many numbers.
PASSES = 10_000
SEED = 17
STEPS = 60
#: Sources up to which weights are solved by name; beyond, by numbers of tokens and how many sources have them.
SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of the whole text; null, empty and white-space texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weights(tokens: dict[str, int], alpha: float, times: dict[str, int] | None = None) -> dict[str, float]:
    """Shares to the power alpha, normalised; sources without tokens have weight zero. times: how many sources each key stands for, one by default."""
    times = times or {}
    total = sum(n * times.get(k, 1) for k, n in tokens.items())
    raw = {k: (n / total) ** alpha if n else 0.0 for k, n in tokens.items()}
    whole = sum(v * times.get(k, 1) for k, v in raw.items())
    return {k: v / whole for k, v in raw.items()}


def entropy(w: dict[str, float], times: dict[str, int] | None = None) -> float:
    return -sum(v * math.log(v) * (times or {}).get(k, 1) for k, v in w.items() if v > 0)


def solve(tokens: dict[str, int], budget: int, target_entropy: float | None = None, max_repeats: float | None = None, times: dict[str, int] | None = None) -> tuple[float, dict[str, float]]:
    """Alpha in 0 to 1 and the weights. times: how many sources each key stands for, one by default. Weights are proportional to tokens at 1 and even at 0.

    With a target entropy (a share 0 to 1 of the way from that of alpha 1 to that of alpha 0): the alpha that
    meets it. With a repetition limit: the least alpha at which no source is drawn more than so often; one
    that even proportional weights exceed gives alpha 1. With both, the larger of the two alphas.
    """
    tokens = {k: n for k, n in tokens.items() if n > 0}
    if not tokens:
        return 1.0, {}
    fits = []
    if target_entropy is not None:
        lo, hi = (entropy(weights(tokens, a, times), times) for a in (1.0, 0.0))
        fits.append(lambda a: entropy(weights(tokens, a, times), times) <= lo + target_entropy * (hi - lo))
    if max_repeats is not None:
        fits.append(lambda a: all(w * budget <= max_repeats * tokens[k] for k, w in weights(tokens, a, times).items()))
    if not fits or all(f(0.0) for f in fits):
        return (0.0, weights(tokens, 0.0, times)) if fits else (1.0, weights(tokens, 1.0, times))
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if all(f(mid) for f in fits) else (mid, high)
    return high, weights(tokens, high, times)


def mix(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.5, max_repeats: float | None = 4.0, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, weight, alpha, copies, block, turns: how often and when each row of docs(doc_id, text, source) is drawn.

    The budget is budget_share of all words. A source's budget is met to within one document, from below:
    a row is drawn in a pass while the words drawn before it are less than the budget. Each pass draws the source's
    blocks in a permutation of its own: turns has, for each copy, how many blocks that pass draws before the row's
    block. A null source is a
    source of its own (null in the result). Rows without words are drawn never and use no budget. Repeated
    rows count as rows of their own but, being alike, share one place in the order: both are drawn or
    neither. Null ids are kept. An empty table gives an empty result; other columns are ignored. Without a
    repetition limit a small source may be drawn very often: over PASSES times is an error.

    Documents are only ever summed by block, so a source with a third of all rows is as many blocks as it needs. Sources
    join by a table that Spark broadcasts or shuffles by its size.
    """
    rows = pick(docs, doc_id="long", text="string", source="string").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), n_words(F.col("text")).alias("n_tokens"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "doc_id", "text", F.lit(seed)).alias("place"))
    rows = settle(rows, "mix-rows")
    sums = settle(rows.groupBy("s", "none").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    alpha, whole, total = _solved(sums, budget_share, target_entropy, max_repeats)
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha)) / whole).otherwise(F.lit(0.0))
    plan = sums.withColumns({"weight": share, "alpha": F.lit(alpha)}).withColumn("want", F.rint(F.col("weight") * budget_share * total).cast("long"))
    each = F.greatest(F.lit(1), "tokens")
    plan = plan.select("s", "none", "weight", "alpha", F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("rows") / block))).cast("long").alias("blocks"), F.floor(F.col("want") / each).alias("passes"), (F.col("want") % each).alias("rest"))
    dealt = rows.join(plan, ["s", "none"]).withColumn("block", F.pmod("place", F.col("blocks")))

    # each block's turn in every pass, in the order that the pass's number gives; the last pass is partial
    by_block = dealt.groupBy("s", "none", "block", "passes", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    turns = by_block.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    order = Window.partitionBy("s", "none", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block")
    turns = turns.withColumns({"turn": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    by_block = turns.groupBy("s", "none", "block").agg(
        F.first("block_tokens").alias("block_tokens"), F.max(F.when(F.col("pass") == F.col("passes"), F.col("before"))).alias("before"),
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "turn"))), lambda t: t["turn"]).alias("turns"),
    )
    keyed = dealt.join(by_block, ["s", "none", "block"])
    fits = F.col("before") + F.col("block_tokens") <= F.col("rest")
    empty = F.col("before") >= F.col("rest")
    cut = keyed.filter(~fits & ~empty)
    within = Window.partitionBy("s", "none", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("last", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) < F.col("rest"))
    out = keyed.filter(fits | empty).withColumn("last", fits).unionByName(cut)
    copies = F.when(F.col("n_tokens") > 0, F.col("passes") + F.col("last").cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", copies)
    return out.select("doc_id", F.when(~F.col("none"), F.col("s")).alias("source"), "n_tokens", "weight", "alpha", "copies", "block", F.slice("turns", F.lit(1), F.col("copies").cast("int")).alias("turns"))


def _solved(sums: DataFrame, budget_share: float, target_entropy: float | None, max_repeats: float | None) -> tuple[float, float, int]:
    """Alpha, the sum of all shares to its power, and all tokens of sums(tokens)."""
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    counted = sums.filter("tokens > 0")
    if small_enough(counted, SOURCES):
        tokens, times = {i: r[0] for i, r in enumerate(counted.select("tokens").orderBy("tokens").collect())}, None
    else:
        found = sorted((t, n) for t, n in counted.groupBy("tokens").agg(F.count("*").alias("n")).collect())
        tokens, times = {i: t for i, (t, _) in enumerate(found)}, {i: n for i, (_, n) in enumerate(found)}
    alpha, _ = solve(tokens, int(budget_share * total), target_entropy, max_repeats, times)
    whole = sum((n / total) ** alpha * (times[k] if times else 1) for k, n in tokens.items())
    most = max(((n / total) ** alpha / whole * budget_share * total / n for n in tokens.values()), default=0)
    if most > PASSES:
        raise ValueError(f"a source would be drawn {most:.0f} times; set max_repeats to {PASSES} or less, or a smaller budget_share")
    return alpha, whole or 1.0, total

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slidemill.llm import mixing
from slidemill.llm.common import table


def test_solve():
    tokens = {"a": 1000, "b": 100, "c": 10}
    alpha, w = mixing.solve(tokens, 1110, target_entropy=0.5)
    lo, hi = (mixing.entropy(mixing.weights(tokens, a)) for a in (1.0, 0.0))
    assert abs(mixing.entropy(w) - (lo + hi) / 2) < 1e-6 and abs(sum(w.values()) - 1) < 1e-9
    _, w = mixing.solve(tokens, 1110, max_repeats=3)
    assert max(w[k] * 1110 / tokens[k] for k in tokens) <= 3 + 1e-6
    assert mixing.solve({}, 0, 0.5) == (1.0, {})
    assert mixing.solve({"a": 5}, 5, 0.5, 4)[1] == {"a": 1.0}
    assert math.isclose(mixing.solve(tokens, 1110)[1]["a"], 1000 / 1110)


def brute(rows, block, budget_share, target, repeats):
    """rows: (doc_id, source, n_tokens, place hash, block hash by number)."""
    tokens = defaultdict(int)
    count = defaultdict(int)
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
        count[r["source"]] += 1
    total = sum(tokens.values())
    alpha, w = mixing.solve(tokens, int(budget_share * total), target, repeats)
    out = []
    for s in tokens:
        want = int(round(w.get(s, 0) * budget_share * total))
        n = max(1, tokens[s])
        passes, rest = divmod(want, n)
        blocks = max(1, -(-count[s] // block))
        own = defaultdict(list)
        for r in rows:
            if r["source"] == s:
                own[r["place"] % blocks].append(r)
        drawn = 0
        for b in sorted(own, key=lambda b: (own[b][0]["order"][passes][b], b)):
            places = defaultdict(list)
            for r in own[b]:
                places[r["place"]].append(r)
            for p in sorted(places):
                take = drawn < rest
                for r in places[p]:
                    out.append((r["doc_id"], s, r["n_tokens"], passes + take if r["n_tokens"] else 0))
                drawn += sum(r["n_tokens"] for r in places[p])
    return out


def check(spark, df, block=20):
    got = mixing.mix(df, block=block)
    rows = mixing.pick(df, doc_id="long", text="string", source="string").select("doc_id", "source", mixing.n_words(F.col("text")).alias("n_tokens"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "doc_id", "text", F.lit(mixing.SEED)).alias("place")).collect()
    top = {(p, b): h for p, b, h in spark.range(6).select(F.col("id").alias("p")).crossJoin(spark.range(200).select(F.col("id").alias("b"))).select("p", "b", F.xxhash64("b", "p", F.lit(mixing.SEED))).collect()}
    order = {p: {b: top[p, b] for b in range(200)} for p in range(6)}
    rows = [r.asDict() | {"order": order} for r in rows]
    want = brute(rows, block, 1.0, 0.5, 4.0)
    assert sorted((tuple(x) for x in got.select("doc_id", "source", "n_tokens", "copies").collect()), key=str) == sorted(want, key=str)
    return got


def test_against_brute_force(spark):
    got = check(spark, table(spark, "/root/testdata/sf0.001", "documents"))
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn"), F.first("weight").alias("w"), F.max("n_tokens").alias("most")).collect()}
    total = got.agg(F.sum("n_tokens")).first()[0]
    assert all(abs(r["drawn"] - r["w"] * total) <= r["most"] + 1 for r in by.values())


def test_edges(spark):
    rows = [(i, "w " * (i % 7), "big" if i % 3 else "small") for i in range(60)] + [(None, "a b", None), (3, None, "big"), (4, "w w w w", "big"), (4, "w w w w", "big"), (5, "x", ""), (9, "long " * 3000, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("copies"), F.lit("q").alias("SOURCE"))
    assert check(spark, df, block=5).count() == len(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_turns_are_permutations(spark):
    """In every pass each block of a source has one turn, and a row has a turn for each copy."""
    rows = [(i, "w " * (1 + i % 9), "big" if i % 4 else "small") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=20).collect()
    assert all(len(r.turns) == r.copies for r in got)
    for source in ("big", "small"):
        own = [r for r in got if r.source == source]
        orders = []
        for p in range(max(r.copies for r in own)):
            turn = {r.block: r.turns[p] for r in own if r.copies > p}
            assert all(r.turns[p] == turn[r.block] for r in own if r.copies > p) and len(set(turn.values())) == len(turn)
            if all(r.copies > p for r in own):
                assert sorted(turn.values()) == list(range(len(turn)))
            orders.append(tuple(b for b, _ in sorted(turn.items(), key=lambda x: x[1])))
        assert len(set(orders)) == len(orders)


def test_many_sources_and_blocks(spark, monkeypatch):
    """A source per row; weights solved by name and by numbers of tokens agree; fewer blocks at most leave the budget as it is."""
    rows = [(i, "w " * (1 + i % 13), f"host{i % 500}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r.doc_id, r.source, r.n_tokens, round(r.weight, 12), round(r.alpha, 9), r.copies)
    by_name = sorted(map(key, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted(map(key, mixing.mix(df).collect())) == by_name
    for most in (2, 65_536):
        monkeypatch.setattr(mixing, "BLOCKS", most)
        got = mixing.mix(spark.createDataFrame([(i, "a b", "one" if i % 3 else "two") for i in range(300)], "doc_id long, text string, source string"), block=10)
        drawn = {r.source: (r.n, r.w) for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"), F.first("weight").alias("w")).collect()}
        assert all(abs(n - w * 600) <= 3 for n, w in drawn.values())


def test_a_source_drawn_without_bound_is_an_error(spark):
    rows = [(0, "one", "tiny")] + [(i, "w " * 500, "big") for i in range(1, 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="max_repeats"):
        mixing.mix(df, target_entropy=1.0, max_repeats=None)
    assert mixing.mix(df, target_entropy=1.0).filter("source = 'tiny'").first().copies <= 4

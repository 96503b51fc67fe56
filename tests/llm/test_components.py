"""Components and the rounds that they take."""

import random

from slidemill.llm import components


def test_stars_take_no_round(spark, monkeypatch):
    made = []
    settle = components.settle
    monkeypatch.setattr(components, "settle", lambda df, what: made.append(what) or settle(df, what))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 60)] + [(7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components.components(stars).collect()} == {(i, i % 3) for i in range(60)}
    assert len(made) == 1


def test_against_plain_search(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == set(root.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chains_take_no_round(spark, monkeypatch):
    """Edges that one task can hold are joined up there; a round of large and small stars is some twenty shuffles of next to no rows."""
    made = []
    settle = components.settle
    monkeypatch.setattr(components, "settle", lambda df, what: made.append(what) or settle(df, what))
    order = random.Random(6).sample(range(3000), 3000)
    chain = spark.createDataFrame([(f"{a:05}".encode(), f"{b:05}".encode()) for a, b in zip(order, order[1:])], "u binary, v binary").repartition(9)
    assert {(bytes(r.node), bytes(r.root)) for r in components.components(chain).collect()} == {(f"{i:05}".encode(), b"00000") for i in range(3000)}
    assert len(made) == 2


def test_more_edges_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", 150)
    order = random.Random(7).sample(range(1000), 1000)
    chains = [(a, b) for i, (a, b) in enumerate(zip(order, order[1:])) if i % 250 < 249]
    want = {n: min(order[i : i + 250]) for i in range(0, 1000, 250) for n in order[i : i + 250]}
    assert {(r.node, r.root) for r in components.components(spark.createDataFrame(chains, "u long, v long").repartition(5)).collect()} == set(want.items())

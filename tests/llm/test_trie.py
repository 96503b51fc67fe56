import hashlib
import zlib
from collections import defaultdict

from slidemill.llm import trie
from slidemill.llm.queries import op11_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, CONV_ID string, node int"


def brute(rows):
    """The trie by plain walks over the rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1].decode()) if path else 0
    return {
        (min(w), len(p), min(members[p[:-1]]) if p else None, len(w), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(w) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, w in members.items()
    }


def test_odd_rows_and_long_conversations(spark):
    rows = [(c, t, "user" if t % 2 else None, f"é{(c // 7 + t) % 3}" if t else "hello") for c in range(-120, 130, 5) for t in range(c % 9)]
    rows += [(c, t, "a", "same") for c in range(400, 420) for t in range(5)]  # copies
    rows += [(701, t % 20 or None, "r", f"x{t % 7}") for t in range(120)]  # a third of all rows, ties, null turns
    rows += [(600, 1, None, None), (600, 1, "", ""), (603, 1, "a", "b"), (603, 1, "a", "b"), (None, 1, "a", "b"), (605, 0, "ab", "c"), (606, 0, "a", "bc")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in trie.prefix_trie(df).select(*COLUMNS).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    assert set(got) == want
    assert any(w[1] == 0 and w[-1] != hashlib.sha256().hexdigest() for w in want)  # turnless ones end at the root


def test_without_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], SCHEMA)).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in op11_prefix_trie(spark, sf).select(*COLUMNS).collect()} == brute(rows)

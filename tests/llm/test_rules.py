import random
import re
from collections import Counter

import pytest

from slidemill.llm import rules

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


TEXTS = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x " * 60, "é# | <b>\n" * 40, "one word here\x1c also\x0bsplit", "line\nline\n line\nline \n\nline", "w1 w2 w3 w4 w1 w2 w3", "a a a a"]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert rules.measure(text)[:5] == brute(text)


def test_measures_of_random_and_long_texts():
    rng = random.Random(1)
    for size in (5, 50, 400, 400, 60_000):
        text = "".join(rng.choice(["a ", "b ", "ü\n", "c\n", "dd#  "]) if size < 1000 else f"w{rng.randrange(300)} " for _ in range(size))
        assert rules.measure(text)[:5] == brute(text)


def words(n, start=0):
    return " ".join(f"word{start + i}" for i in range(n))


def test_hosts(spark):
    """A host of short texts takes its one good text with it; a small one with one bad text of two doesn't."""
    rows = [(i, words(10, i), "bad") for i in range(200)] + [(200, words(80), "bad")]
    rows += [(300 + i, words(60, i), "good") for i in range(400)] + [(800 + i, words(60, 9 * i), f"h{i}") for i in range(40)]
    rows += [(900, words(5), "small"), (901, words(70), "small"), (902, words(70), None), (None, words(70), None), (903, None, ""), (903, None, "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_words int")
    got = rules.judge(df)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [tuple(by_id[i][c] for c in COLUMNS[1:6]) for i, t, _ in rows] == [brute(t) for _, t, _ in rows]
    assert all(r.base_failed == (r.n_words < 50) for r in by_id.values())
    assert {i for i, r in by_id.items() if r.host_rejected} == set(range(201))
    assert not by_id[200].base_failed and not by_id[200].kept and by_id[901].kept and by_id[902].kept and by_id[None].kept and not by_id[903].kept
    mean, strength = rules.priors(rules.failures(spark.createDataFrame([(h, n) for h in "abcd" for n in [10] * 5 + [60] * 5], "host string, n_words long").selectExpr("host", "n_words", "n_words as word_chars", "0 as n_symbols", "0 as n_dup_lines", "0 as n_repeat_words", "1 as n_lines")))["few_words"]
    assert mean == 0.5 and strength == float("inf")  # hosts alike


def test_many_rejected_hosts(spark, monkeypatch):
    rows = [(i, words(10), f"h{i % 30}") for i in range(3000)] + [(5000 + i, words(60), f"g{i % 9}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, rules.judge(df).collect()))
    monkeypatch.setattr(rules, "BROADCAST", 0)
    assert sorted(map(tuple, rules.judge(df).collect())) == want
    assert sum(r[-2] for r in want) == 3000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert rules.judge(df).select(*COLUMNS).collect() == []

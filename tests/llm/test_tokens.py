import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slidemill.llm import tokens
from slidemill.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def n(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.count_tokens(docs, PATH).collect():
        assert (r.n_tokens, r.n_bytes) == (n(texts[r.doc_id]), len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 512) and n(texts[r.doc_id][: r.fit_chars]) <= 512


def test_prefixes_by_the_library():
    own, r = tokens.counter(PATH), random.Random(1)
    bits = ["a", "e", "the", " ", "  ", "\n", "'s", "é", "ß", "1", "2024", "--", "<|endoftext|>", "<|endof", "hello", "\t", "日本", "😀", "ing", "\x1c", "\xa0"]
    for _ in range(300):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        counts = own.prefixes(s)
        assert len(counts) == len(s) + 1 and counts[-1] == n(s)
        for k in range(len(s) + 1):
            assert counts[k] == n(s[:k]), (s, k)


def test_prefixes_cut_in_space_contractions_and_special_tokens():
    own = tokens.counter(PATH)
    for s in (".\n\nthe cat", "a  \n 're it's we'll", "x<|endoftext|><|endoftext|> \n<|endoftext|>'s", "  \u3000\xa0 b", "'s's '", "end \t "):
        assert own.prefixes(s) == [n(s[:k]) for k in range(len(s) + 1)], s


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a <|endoftext|> b"), (1, None), (3, "ab" * 200_000), (4, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("q").alias("Text"), F.lit(0).alias("n"))
    out = sorted(tokens.count_tokens(df, PATH).collect(), key=str)
    assert sorted(r.n_tokens for r in out) == sorted(n(t) for _, t in rows)
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
    assert tokens.prefix_counts(df.filter("doc_id = 2"), PATH).first().counts == [0]

"""run() against the same stages done by hand on the driver."""

from pyspark.sql import functions as F

import corpus_pipeline
from slidemill.llm import language, mixing, toxicity
from slidemill.llm.common import table
from tests.llm.test_decontaminate import contained
from tests.llm.test_nearcopies import brute_shingles


def brute_firsts(texts):
    """Ids of the first of each component of texts alike by 0.8 or more, by all pairs of sets."""
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in texts}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    model = language.train(language.training_rows(docs))
    said = {i: model.predict(r["text"]) for i, r in rows.items()}
    rows = {i: r for i, r in rows.items() if said[i][0] != "und" and said[i][1] >= language.SURE}
    left = docs.filter(docs.doc_id.isin(list(rows)))
    net = toxicity.train(toxicity.training_rows(left), table(spark, sf, "labels"))
    rows = {i: r for i, r in rows.items() if net.score([r["text"]])[0] < 0.5}
    firsts = brute_firsts({i: r["text"] for i, r in sorted(rows.items())})
    rows = {i: r for i, r in rows.items() if i in firsts}
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    rows = {i: r for i, r in rows.items() if not any(contained(r["text"], t) for t in items)}
    want = {r.doc_id: r.copies for r in mixing.mix(docs.filter(docs.doc_id.isin(list(rows)))).collect()}
    got = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and set(want) == set(rows)


def test_stages_keep_columns_and_clean_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_neardup", "decontamination", "mixing"]
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_stages_with_nulls_repeats_ties_and_clashing_names(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.filter("doc_id < 40").collect()]
    at = {c: i for i, c in enumerate(docs.columns)}
    clean = next(r for r in sorted(rows) if r[at["lang"]] == "en" and r[at["text"]] and 200 < len(r[at["text"]]) < 3000)
    put = lambda **v: tuple(v.get(c, clean[i]) for c, i in at.items())
    odd = [put(doc_id=None), put(doc_id=None), put(doc_id=9_001, source=None), put(doc_id=9_001, source=None), put(doc_id=9_001, lang=None), put(doc_id=9_002, text=None), put(doc_id=9_003, text=""), put(doc_id=9_004, text=" \n"), put(doc_id=9_005, n_chars=None)]
    df = spark.createDataFrame(rows + odd, docs.schema)
    df = df.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("p"), F.lit(2).alias("key"), F.lit(3).alias("c0"), F.create_map(F.lit("a"), F.lit(1)).alias("last"))
    of = lambda out: [tuple(r)[: len(at)] for r in out.collect()]
    mine = lambda found: sorted([r for r in found if r in odd], key=str)
    blank = [r for r in odd if not (r[at["text"]] or "").strip()]
    said = [r for r in odd if r not in blank]
    stages = dict(corpus_pipeline.STAGES)
    out = {n: f(spark, df, sf) for n, f in corpus_pipeline.STAGES[:-1]}
    assert all(o.columns == df.columns for o in out.values())
    assert mine(of(out["language_id"])) == sorted(said, key=str)
    assert mine(of(out["toxicity"])) == mine(of(out["decontamination"])) == sorted(odd, key=str)
    # all of them are copies of a row with a smaller id, and one of the blank texts stays
    assert clean in of(out["simhash_neardup"]) and len(mine(of(out["simhash_neardup"]))) <= 1
    assert set(mine(of(out["simhash_neardup"]))) <= {odd[5]}
    # by themselves, one row of a tie stays, and of equal rows one
    alone = of(stages["simhash_neardup"](spark, spark.createDataFrame(odd[:5], docs.schema), sf))
    assert len(alone) == 1 and alone[0][at["doc_id"]] == 9_001
    assert of(stages["simhash_neardup"](spark, spark.createDataFrame(odd[:2], docs.schema), sf)) == odd[:1]
    mixed = stages["mixing"](spark, df, sf).collect()
    assert len(mixed) == len(rows) + len(odd) and {r.copies for r in mixed if r.doc_id in (9_002, 9_003, 9_004)} == {0}

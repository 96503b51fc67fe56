import math
from collections import Counter

from pyspark.sql import functions as F

from slidemill.llm import language
from slidemill.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_edges(spark):
    rows = [(1, "the and of with", "en"), (2, None, "en"), (3, "", "fr"), (4, "12 34 --", "fr"), (None, "le la les des", "fr"), (1, "the and of with", "en"), (7, "x" * 2_000_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit("no").alias("LANG"), F.lit(1.0).alias("score"))
    out = language.identify(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {2, 3, 4}
    assert language.keep_identified(df, least=0.0).count() == 4
    assert sorted(r.text for r in language.keep_identified(df).collect()) == ["le la les des", "the and of with", "the and of with"]  # a row of x is no language
    assert language.keep_identified(df).columns == df.columns
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(none).count() == 0
    unlabelled = language.identify(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_unsure_and_unwanted_texts_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = language.train(language.training_rows(docs))
    said = {r.doc_id: model.predict(r.text) for r in docs.collect()}
    own = {i for i, (lang, _) in said.items() if lang != "und"}
    for least in (language.SURE, 0.9):
        kept = {r.doc_id for r in language.keep_identified(docs, least=least).collect()}
        assert kept == {i for i in own if said[i][1] >= least}
        assert least > 0.8 and 0 < len(own - kept) < 0.1 * len(own) or len(own - kept) <= len(own) // 1000
    english = language.keep_identified(docs, wanted=("en",)).groupBy("lang").count().collect()
    right = {r.lang: r["count"] for r in english}
    assert right["en"] / sum(right.values()) > 0.98
    assert language.keep_identified(docs, least=0.0).count() == len(own)


def test_families():
    assert language.family_of("fr") == language.family_of("es") != language.family_of("de") == language.family_of("en")
    assert language.family_of("xx") == "xx"


def slow_predict(model, text):
    """Family, then language, by counting each n-gram of bytes by itself."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, counts = f" {text.lower()} ".encode(), Counter()
    for place, n in enumerate(language.SIZES):
        for at in range(len(data) - n + 1):
            h = 0
            for byte in data[at : at + n]:
                h = (h * 0x100000001B3 + byte + 1) % 2**64
            counts[place * language.BUCKETS + ((h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * n) % 2**64 >> 40) % language.BUCKETS] += 1

    def margin(a, b):
        k = model.pairs.index((a, b))
        return language.SCALE * sum(c * float(model.weights[i, k]) for i, c in counts.items()) / sum(counts.values()) + model.bias[k]

    sure = []

    def choose(among):
        games = {(a, b): margin(a, b) for i, a in enumerate(among) for b in among[i + 1 :]}
        key = lambda k: (sum((m >= 0) == (k == a) for (a, b), m in games.items() if k in (a, b)), sum(m if k == a else -m for (a, b), m in games.items() if k in (a, b)))
        best = max(among, key=key)
        sure.extend(m if best == a else -m for (a, b), m in games.items() if best in (a, b))
        return best

    lang = choose(model.langs[choose(sorted(model.langs))])
    return lang, 1 / (1 + math.exp(-2 * min([3.0, *sure])))


def test_predictions_by_plain_loops(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(language.training_rows(docs))
    texts = [None, "", "12 --", "x", "Élan ÉTÉ 日本", *[r.text[:1500] for r in docs.filter("text is not null").orderBy("doc_id").limit(60).collect()]]
    for t in texts:
        (lang, score), (want, sure) = model.predict(t), slow_predict(model, t)
        assert lang == want and (abs(score - sure) < 1e-6 or min(score, sure) > 0.997), t

"""The experiment grid on features that are written once, against the pipelines that make them at each use."""

from pyspark.sql import functions as F

from tidewater.functions.text import clean_ml, spaced_ml
from tidewater.operators import classifier as K
from tidewater.operators import terms as W
from tidewater.operators.features import tokens

WORDS = {"a": "red green blue apple plum river", "b": "north south apple west hill river", "c": "one two red four five hill"}


def texts(n):
    return [(i, None if i == 4 else "" if i == 5 else " ".join(WORDS["abc"[i % 3]].split()[(i // 3 * k + k) % 6] for k in range(1, 4)) + " 7" * (i % 4 == 1), "abc"[i % 3]) for i in range(n)]


def test_grid_tells_what_its_pipelines_tell(spark, monkeypatch):
    table = spark.createDataFrame(texts(90), "id long, text string, label string")
    train = table.filter("id < 60 AND (label <> 'c' OR id < 20)")
    test = table.filter("id >= 60").unionByName(spark.createDataFrame([(99, None, None), (98, "red", "other")], table.schema))
    expected = set()
    for n in (1, 2):
        for name, on in (("none", False), ("balanced", True)):
            told = K.probabilities(test, K.logistic(train, "label", 20, n, on), n)
            expected.add((n, name, 32, told.filter("predicted = label").count()))
    # Features are made in two writes a length of runs, not at each fit.
    made, real = [], K.term_features
    monkeypatch.setattr(K, "term_features", lambda *a: made.append(1) or real(*a))
    assert {tuple(r) for r in K.grid(train, test, "label", size=20).collect()} == expected and len(made) == 4


def test_features_equal_those_of_the_stages(spark):
    table = spark.createDataFrame(texts(40), "id long, text string, label string")
    rows = K.prepared(table)
    expected = rows
    for stage in K.feature_stages(rows, 20):
        expected = (stage.fit(expected) if hasattr(stage, "fit") else stage).transform(expected)
    stages = K.feature_stages(rows, 20)
    scales = [table.select(F.max(f)).first()[0] or 1.0 for f in K.flags_of(F.coalesce("text", F.lit(""))).values()]
    worded = K.cleaned(table).select("id", W.joined(F.col("_tokens")).alias("words"), F.lit("").alias("_all"), *K.FLAG_NAMES)
    got = K.term_features(worded, ["id"], stages[0].vocabulary, stages[1].getScalingVec().toArray().tolist(), scales, 2)
    known = {r["id"]: r["features"].toArray() for r in expected.select("id", "features").collect()}
    told = {r["id"]: r["features"].toArray() for r in got.collect()}
    assert known.keys() == told.keys() and all(abs(known[i] - told[i]).max() < 1e-12 for i in known)


def test_half_cleaned_texts_have_the_same_words(spark):
    odd = ["a.apk!!b", "xhttps://a.b/c d", "don’tʼs o`k", "a!!!b.c", "x..y.z", "été…ça va", "a​b́c", "İ. I.x", "1.a 22", "\U0001d400x.a'b", "a_b-c.d/e:f", "\ta.\nb ", "http://x.apk", "á.ab!c.é", None, ""]
    docs = spark.createDataFrame([(t,) for t in odd], "text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    both = docs.select(tokens(clean_ml(F.col("text"))).alias("a"), tokens(spaced_ml(F.col("text"))).alias("b")).collect()
    assert len(both) > 200 and all(r["a"] == r["b"] for r in both)

"""Classifiers on held-out rows; near-duplicate removal by brute force; checks on odd input."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tidewater.operators import analyze as A
from tidewater.operators import checks as C
from tidewater.operators import classifier as K
from tidewater.operators.near import drop_near
from tidewater.sources import files as S

WORDS = {"a": "red green blue apple pear plum", "b": "north south east west hill river", "c": "one two three four five six"}


def texts(n):
    return [(i, " ".join(WORDS["abc"[i % 3]].split()[(i // 3 + k) % 6] for k in range(4)), "abc"[i % 3]) for i in range(n)]


def test_classifiers_judge_unseen_rows(spark):
    table = spark.createDataFrame(texts(90), "id long, text string, label string")
    train, test = table.filter("id < 60"), table.filter("id >= 60").unionByName(spark.createDataFrame([(99, None, None)], table.schema))
    told = K.probabilities(test, K.logistic(train, "label", size=50)).collect()
    assert len(told) == 31 and all(r["predicted"] == r["label"] for r in told if r["label"])
    assert all(abs(r["p_a"] + r["p_b"] + r["p_c"] - 1) < 1e-6 for r in told)
    top = K.coefficients(K.logistic(train, "label", size=50), 3).filter("side = 'for'").collect()
    assert {r["label"] for r in top} == {"a", "b", "c"} and all(set(r["term"].split()) <= set(WORDS[r["label"]].split()) for r in top)
    boosted = K.predictions(table.filter("id >= 60"), K.boosted(train, "label", F.col("id") % 5 == 0, size=50, rounds=4, patience=2, rate=1.0)).collect()
    assert sum(r["predicted"] == r["label"] for r in boosted) > 20


def cosine(a, b, idf):
    dot = sum(a[t] * b[t] * idf[t] ** 2 for t in a.keys() & b.keys())
    return dot / math.sqrt(sum((a[t] * idf[t]) ** 2 for t in a) * sum((b[t] * idf[t]) ** 2 for t in b))


def test_near_duplicates_go_in_row_order(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base), "x"), (1, " ".join(base), "x"), (2, " ".join(base[:-1]), "x"), (3, " ".join(base[:-2] + ["other"]), "x"), (4, " ".join(base), "y"), (5, "", "x"), (6, None, "x")]
    rows += [(10 + k, " ".join(base[k:] + [f"new{j}" for j in range(k)]), "x") for k in range(6)]
    kept = {r["id"] for r in drop_near(spark.createDataFrame(rows, "id long, text string, label string"), "id", "label").collect()}
    own = [(i, Counter(w := (t or "").split()) + Counter(map(" ".join, zip(w, w[1:])))) for i, t, label in rows if label == "x"]
    df = Counter(t for _, c in own for t in c)
    idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}
    expected: list = []
    for i, c in own:
        if not c or all(not o or cosine(c, o, idf) <= 0.95 for _, o in expected):
            expected.append((i, c))
    assert kept == {i for i, _ in expected} | {4}
    assert drop_near(spark.createDataFrame([], "id long, text string, label string"), "id", "label").count() == 0


def test_analysis_of_odd_messages(spark):
    rows = [(1, None), (2, "  "), (3, "kodni yuboring"), (4, "bu kodni hech kimga bermang"), (5, "a.apk")]
    told = {r["id"]: r for r in A.analyze(spark.createDataFrame(rows, "id long, message string")).filter("level IS NOT NULL").collect()}
    assert [told[i]["risk"] for i in (1, 2)] == [0, 0] and told[1]["reasons"] == [] and told[2]["advice"] == [A.EMPTY_ADVICE]
    assert told[3]["risk"] >= 85 and told[3]["level"] == "XAVFLI" and told[5]["risk"] >= 90 and told[4]["intent"] == "WARNING"
    with_model = A.analyze(spark.createDataFrame([(1, "salom")], "id long, message string"), F.lit(0.95), F.lit(0.02)).first()
    assert with_model["risk"] == 70 and with_model["confidence"] == "yuqori"


def test_checks_on_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string, lang string, ts timestamp")
    assert C.violations(none, ("text", "label"), {"lang": ("en",)}).count() == 1
    assert C.positional_differences(none, none, "id", "text").count() == 0 and C.ends(none, "id", 3).count() == 0
    assert all(log.count() == 0 for log in C.side_logs(none.withColumn("label", F.lit("a")), "text", "label", "lang", "id").values())
    S.write_csv(spark.createDataFrame([('a "quoted", text\nof lines ', "x")], "text string, label string"), str(tmp_path / "c"))
    assert S.sniff_separator(spark, str(tmp_path / "c")) == "," and S.scan(spark, S.FileSpec("c", str(tmp_path / "c"))).first()["text"] == 'a "quoted", text\nof lines '
    (tmp_path / "latin.csv").write_bytes("é".encode("latin-1"))
    assert S.fitting_encoding(spark, str(tmp_path / "latin.csv")) == "ISO-8859-1" and S.fitting_encoding(spark, str(tmp_path / "c")) == "UTF-8"

"""Texts are read once: letters by runs, patterns after a part that they need, keywords a text at a time."""

import re

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import rules
from tidewater.plans import curation as C


def test_letters_are_counted_once(spark):
    rows = [("", "unknown"), ("12 !", "unknown"), ("привет мир", "ru"), ("ўзбек", "uz"), ("hello you", "en"), ("bog' g‘oz", "uz"), ("hello мир при", "mixed"), (None, None)]
    told = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.script_language(F.col("t")))
    assert [(r["t"], r["got"]) for r in told.collect()][:7] == rows[:7]
    assert told.select("got")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


MATCHED = ["karta raqam", "kod ni yubor", "otp", "hisobingiz da xavf", "blocked", "yutib", "i won", "pul ni yubor", "verify the link", "hoziroq", "administrator", "ish taklif", "работа мы предлаг",
           "crypto", "see x.click", "ko'rishamiz", "see you", "hello", "kod", "hisobingiz", "pul", "verify", "nothing"]


@pytest.mark.parametrize("name", list(C.PATTERNS))
def test_a_pattern_needs_its_parts(spark, name):
    told = spark.createDataFrame([(t,) for t in [*MATCHED, None]], "low string").filter(C.matches(F.col("low"), name)).collect()
    assert sorted(r["low"] for r in told) == sorted(t for t in MATCHED if re.search(C.PATTERNS[name], t))


def test_keywords_with_and_without_capitals(spark):
    rows = spark.createDataFrame([("a b.c X",), ("x",), (None,), ("",)], "t string")
    for words, want in (({"one": ("abc",), "two": ("zz",)}, [["one"], [], [], []]), ({"one": ("abc",), "two": ("X",)}, [["one", "two"], ["two"], [], []])):
        found = rules.match_lexicon(F.col("t"), words)
        assert [r[0] for r in rows.select(found).collect()] == want
        assert rules.ahocorasick is None or "ArrowEvalPython" in rows.select(found)._jdf.queryExecution().executedPlan().toString()
        one = rows.select(found)._jdf.queryExecution().optimizedPlan().toString()
        assert rules.ahocorasick is None or ("of_both" in one) == ("X" in words["two"])

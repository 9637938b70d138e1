"""Fusion and the label of three probabilities at every border, and the queries that read them from tables."""

import itertools
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions import fusion
from tidewater.plans import checks, messages

RULES, FLOORS = (0, 39, 40, 54, 55, 60, 61, 69, 70, 100), (0, 5, 40, 60, 70, 95)
DANGER, SUSPICION = (0.0, 0.49, 0.5, 0.59, 0.6, 0.89, 0.9), (0.0, 0.5, 0.51, 0.69, 0.7)


def fused(rule, floor, d, s, hard):
    """In single precision, one rule after the other."""
    one = np.float32
    ml = min(max(one(d) * one(100) + one(s) * one(50), one(0)), one(100))
    risk = one(max(rule, floor))
    if d >= 0.9:
        risk = max(risk, one(90))
    elif (d >= 0.5 or s >= 0.7) and ml > risk:
        risk = max(risk, risk * one(0.4) + ml * one(0.6))
    if not hard:
        risk = min(risk, one(60))
    if 55 <= risk < 70 and (d >= 0.5 or ml >= 65):
        risk = one(70)
    if s > 0.5 and not hard and risk < 40:
        risk = one(40)
    return int(min(max(risk, one(0)), one(100)))


def labelled(d, s, safe):
    return "DANGEROUS" if d >= 0.6 or d >= max(s, safe) else "SUSPICIOUS" if s >= safe else "SAFE"


def test_fusion_at_every_border(spark):
    cases = list(itertools.product(RULES, FLOORS, DANGER, SUSPICION, (True, False)))
    table = spark.createDataFrame(cases, "rule int, floor int, d double, s double, hard boolean")
    risk = fusion.fuse(*(F.col(c) for c in table.columns))["risk"]
    assert {tuple(r)[:5]: r["risk"] for r in table.withColumn("risk", risk).collect()} == {c: fused(*c) for c in cases}


def test_label_at_every_border(spark):
    cases = [(d, s, safe) for d in DANGER for s in SUSPICION for safe in (0.0, 0.5, 0.6, 1.0)]
    table = spark.createDataFrame(cases, "d double, s double, safe double")
    label = fusion.model_label(*(F.col(c) for c in table.columns))
    assert {tuple(r)[:3]: r["label"] for r in table.withColumn("label", label).collect()} == {c: labelled(*c) for c in cases}


def events(spark, path, rows):
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, at timestamp")
    table.select("event_id", "user_id", "event_type", "value", F.col("at").cast("timestamp_ntz").alias("ts")).write.parquet(f"{path}/events.parquet")


def test_queries_fuse_the_shares_of_a_day(spark, tmp_path):
    day, next_day = datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 12)
    rows = [
        (1, 1, "error", 10.0, day),
        (2, 1, "error", 10.0, day),
        (3, 1, "click", 80.0, next_day),
        (4, 2, "click", 30.0, day),
        (5, 2, "view", 30.0, day),
        (6, 2, None, 30.0, day),
        (7, 3, "purchase", 20.0, day),
    ]
    events(spark, str(tmp_path), rows)
    risks = {r["event_id"]: (r["risk"], r["band"]) for r in messages.QUERIES["q_fusion"](spark, str(tmp_path)).collect()}
    probable = {1: (1.0, 0.0), 2: (1.0, 0.0), 3: (0.0, 1.0), 4: (0.0, 0.5), 5: (0.0, 0.5), 7: (0.0, 0.0)}
    floors = {"error": 5, "purchase": 60}
    kinds = {r[0]: (r[2], r[3]) for r in rows}
    told = {i: fused(int(kinds[i][1]) % 101, floors.get(kinds[i][0], 0), d, s, i % 2 == 0) for i, (d, s) in probable.items()}
    assert {i: r for i, (r, _) in risks.items()} == told and risks[2] == (90, "DANGEROUS")
    labels = {(r["user_id"], r["day"]): r["label"] for r in messages.QUERIES["q_model_label"](spark, str(tmp_path)).collect()}
    # A tie of clicks and others goes to the graver one.
    assert labels == {(1, "2024-01-01"): "DANGEROUS", (1, "2024-01-02"): "SUSPICIOUS", (2, "2024-01-01"): "SUSPICIOUS", (3, "2024-01-01"): "SAFE"}


def test_fusion_of_no_events(spark, tmp_path):
    events(spark, str(tmp_path), [])
    assert all(messages.QUERIES[q](spark, str(tmp_path)).count() == 0 for q in ("q_fusion", "q_model_label"))


def test_every_supplier_fills_every_template(spark, tmp_path):
    spark.createDataFrame([(1, "A {sum}"), (2, None)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    told = checks.QUERIES["q_templates"](spark, str(tmp_path)).collect()
    of = lambda key, k: sorted(str(r["text"]) for r in told if (r["s_suppkey"], r["template"]) == (key, k))
    assert of(1, 1) == ["open a.example.org", "open b.example.org"] and of(1, 2) == ["no slot at all"]
    assert {(r["s_suppkey"], r["template"]) for r in told} == {(s, k) for s in (1, 2) for k in range(4)}

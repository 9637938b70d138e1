"""Bounded state, the store and model tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import classifier as K
from tidewater.operators import model_tables as T
from tidewater.operators import rules
from tidewater.operators.checks import looked_up
from tidewater.session import scratch
from tidewater.streaming import alerts, limits
from tidewater.streaming.replay import replayed
from tidewater.streaming.store import HistoryStore

START = 1_704_067_200_000
ROWS = "device string, id long, ms long, item string, action string, score double"


def stream_of(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("at", F.timestamp_millis("ms"))


def judge(spark, rows, processor, kind, slices=2):
    """Results by id, the stream stopped and started again between slices."""
    build = lambda s: limits.judged(limits.stream_rows(s, F.col("device"), F.col("id"), "at", F.col("item"), F.col("action"), F.col("score")), processor, kind)
    found = replayed(stream_of(spark, rows), "at", build, slices).collect()
    assert len(found) == len({r["id"] for r in found})
    return {r["id"]: r[processor.result] for r in found}


def random_rows(n, step, items, seed):
    rng = random.Random(seed)
    ms, rows = START, []
    for i in range(n):
        ms += rng.choice([0, 1, step // 2, step, 3 * step])
        rows.append((rng.choice([None, "a", "b"]), i, ms, rng.choice([None, *(f"i{k}" for k in range(items))]), rng.choice(["add", "add", "add", "remove"]), rng.choice([None, 39.0, 40.0, 69.0, 70.0])))
    return rows


def registry(rows, most, age):
    held, counters, out = {}, {}, {}
    for device, i, ms, item, action, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        device, item = device or "", item or ""
        mine = held.setdefault(device, {})
        for k in [k for k, (t, _) in mine.items() if ms - t > age]:
            del mine[k]
        if action == "remove":
            out[i] = mine.pop(item, (0, None))[1]
            continue
        if item not in mine:
            counters[device] = counters.get(device, 0) + 1
        number = mine[item][1] if item in mine else 9_999 + counters[device]
        mine[item] = (ms, number)
        while len(mine) > most:
            del mine[min(mine, key=mine.get)]
        out[i] = number
    return out


def test_registry_by_plain_python(spark):
    rows = random_rows(300, 400, 12, 1)
    assert judge(spark, rows, limits.IdRegistry(4, 2_000), "long") == registry(rows, 4, 2_000)
    assert judge(spark, [], limits.IdRegistry(), "long", 1) == {}


def test_timers_free_what_expired(spark):
    day = 24 * 60 * 60 * 1000
    rows = [("a", i, START + i * day, f"i{i % 2}", "add", None) for i in range(8)]
    # Exactly a day old still counts: i0 is gone when it comes again, two days later.
    assert judge(spark, rows, limits.IdRegistry(), "long", 4) == {i: 10_000 + i for i in range(8)}
    assert judge(spark, [("a", i, START + i * day, "same", "add", None) for i in range(4)], limits.IdRegistry(), "long", 4) == dict.fromkeys(range(4), 10_000)


def test_persistent_limiter(spark):
    s = 1_000
    rows = [
        ("a", 0, START, "x", "add", 50.0), ("a", 1, START + 2 * s, "y", "add", 50.0), ("a", 2, START + 3 * s, "x", "add", 40.0), ("a", 3, START + 6 * s, "y", "add", 69.0),
        ("a", 4, START + 7 * s, "z", "add", 70.0), ("a", 5, START + 9 * s, "z", "add", 55.0), ("a", 6, START + 12 * s, "w", "add", 55.0), ("a", 7, START + 14 * s, "z", "remove", None),
        # The refused alert of second 12 has moved the clock: 14.5 is too near to it.
        ("a", 8, START + 14 * s + 500, "w", "add", 55.0), ("a", 9, START + 15 * s, "w", "add", 55.0), ("a", 10, START + 16 * s, "q", "remove", None), (None, 11, START + s, "x", "add", None),
    ]
    assert judge(spark, rows, limits.PersistentLimiter(), "string") == {
        0: "shown", 1: "spacing", 2: "duplicate", 3: "shown", 4: "band", 5: "shown", 6: "full", 7: "removed", 8: "spacing", 9: "shown", 10: "unknown", 11: "band",
    }


def test_cache_evicts_its_oldest(spark):
    rows = random_rows(300, 100, 30, 2)
    held, out = {}, {}
    for device, i, ms, item, _, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = held.setdefault(device or "", {})
        for k in [k for k, t in mine.items() if ms - t > 5_000]:
            del mine[k]
        if len(mine) > 10:
            for k in sorted(mine, key=lambda k: (mine[k], k))[:4]:
                del mine[k]
        out[i] = (item or "") in mine
        mine.setdefault(item or "", ms)
    assert judge(spark, rows, limits.SeenCache(10, 4, 5_000), "boolean") == out


def test_limits_forget_and_refuse_rows_without_a_time(spark):
    rows = [("a", i, START + i * 40_000, "x", "add", 50.0) for i in range(12)]
    stream = stream_of(spark, rows).unionByName(stream_of(spark, rows[:1]).withColumns({"id": F.lit(99).cast("long"), "at": F.lit(None).cast("timestamp")}))
    found = replayed(stream, "at", lambda s: alerts.limit_alerts(s, "device", "id", (1, 60_000), "at", late="1 second"), 4).collect()
    assert {r["id"]: r["accepted"] for r in found} == {i: i % 2 == 0 for i in range(12)} | {99: False}


def test_store_takes_each_batch_once(spark):
    store = HistoryStore(spark, scratch(spark, "store"), "id", "at", 2, fold_every=2)
    day = 86_400_000
    batch = lambda *rows: spark.createDataFrame(list(rows), "id long, d long, v string").select("id", F.timestamp_millis(F.lit(START) + F.col("d") * day).alias("at"), "v")
    schema = batch((1, 0, "")).schema
    now = lambda: {r["id"]: r["v"] for r in store.rows(schema.names, schema).collect()}
    assert now() == {}
    assert store.apply(batch((1, 0, "a"), (2, 1, "b"), (2, 0, "older")), 0) and now() == {1: "a", 2: "b"}
    assert store.apply(batch((1, 3, "c"), (3, 0, "late")), 1) and now() == {1: "c", 2: "b"}
    assert not store.apply(batch((9, 9, "repeated")), 1) and not store.apply(batch((9, 9, "repeated")), 0)
    reader = store.rows(schema.names, schema)
    # An attempt that broke off before its commit isn't seen.
    batch((8, 3, "lost")).withColumn("_batch", F.lit(2).cast("long")).write.parquet(f"{store.path}/data/2-broken")
    assert now() == {1: "c", 2: "b"} and store.apply(batch((4, 5, "d"), (None, 5, "none")), 2) and now() == {1: "c", 4: "d", None: "none"}
    assert {r["id"] for r in reader.collect()} == {1, 2}
    assert store.apply(batch().limit(0), 3) and now() == {1: "c", 4: "d", None: "none"}
    assert sum(c.base for c in store.commits()) >= 1


def test_parts_of_a_message(spark):
    rows = [(1, 1, "b "), (1, 0, " a"), (2, 0, " "), (3, 0, None), (1, 2, None)]
    parts = spark.createDataFrame(rows, "message_id long, part int, body string").withColumns({"sender": F.lit(" "), "at": F.timestamp_millis(F.lit(START) + F.col("part"))})
    assert [tuple(r) for r in alerts.joined_parts(parts).collect()] == [(1, "ab", "Unknown")]
    assert [tuple(r)[:3] for r in alerts.joined_parts(parts, "at").select("message_id", "text", "sender").collect()] == [(1, "ab", "Unknown")]


def test_model_tables_agree_with_the_model(spark):
    words = {"a": "red green blue apple", "b": "north south east west"}
    table = spark.createDataFrame([(i, " ".join(words["ab"[i % 2]].split()[(i // 2 + k) % 4] for k in range(3)) + " 7" * (i % 3), "ab"[i % 2]) for i in range(60)], "id long, text string, label string")
    odd = spark.createDataFrame([(100, None, None), (101, "", None), (102, "unknown words only", None)], table.schema)
    model = K.logistic(table.filter("id < 40"), "label", size=30)
    path = scratch(spark, "model")
    K.as_tables(model).save(path)
    rows = table.filter("id >= 40").unionByName(odd)
    told = {r["id"]: r for r in K.told_by_tables(rows, T.load_model(spark, path), "id").collect()}
    for r in K.probabilities(rows, model).collect():
        assert told[r["id"]]["predicted"] == r["predicted"] and abs(told[r["id"]]["p_a"] - r["p_a"]) < 1e-9
        assert abs(r["p_a"] + r["p_b"] - 1) < 1e-9
    assert len(K.labels_of(model)) == model.stages[-1].numClasses == 2


def test_boosting_ends_early(spark):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, f"{'left' if i % 2 else 'right'} noise{rng.randrange(5)}", "ab"[i % 2] if rng.random() < 0.9 else "ab"[1 - i % 2]) for i in range(80)], "id long, text string, label string")
    model = K.boosted(table, "label", F.col("id") % 4 == 0, size=20, rounds=9, patience=1, rate=1.0, depth=1, least=0.05)
    # One round more than the best had been tried.
    assert len(model.losses) == len(model.rounds) + 1 < 9 and model.losses[-1] > model.losses[-2] - 0.05
    assert K.predictions(table, model).filter("predicted = label").count() > 60


@pytest.mark.parametrize("automaton", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_lexicon_in_one_pass(spark, monkeypatch, seed, automaton):
    if not automaton:
        monkeypatch.setattr(rules, "ahocorasick", None)
    elif rules.ahocorasick is None:
        pytest.skip("the automaton's library isn't there")
    rng = random.Random(seed)
    letters = "ab. o‘A"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    lexicon = {f"s{k}": tuple(word(5) for _ in range(rng.randint(0, 4))) for k in range(12)}
    texts = [None, "", *(word(30) for _ in range(60))]

    def plain(text):
        bare = lambda t: t.replace(" ", "").replace(".", "")
        return [name for name, words in lexicon.items() if any(bare(w.lower()) in bare(text or "") or (w != w.lower() and w in (text or "")) for w in words)]

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", rules.match_lexicon(F.col("text"), lexicon).alias("s")).collect()
    assert {r["id"]: r["s"] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_lookup_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (1, "x")], "id int, k string")
    names = spark.createDataFrame([("x", "X")], "k string, v string")
    assert sorted((r["id"], r["v"]) for r in looked_up(rows, names, "k", "v", "none").collect()) == [(1, "X"), (1, "X"), (2, "none"), (3, "none")]
    assert looked_up(rows, names.limit(0), "k", "v", "none").filter("v = 'none'").count() == 4

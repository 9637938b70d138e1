"""Near pairs by blocks and folded vectors, and counted terms, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewater.operators import near as N
from tidewater.operators import terms as T


def rows(n=160):
    """Texts of two groups with copies, near copies, an empty and a null one."""
    chance, texts = random.Random(3), []
    for i in range(n):
        words = [f"w{int(chance.paretovariate(0.8)) % 120}x" for _ in range(chance.randint(1, 60))]
        if i % 3 and texts:
            words = list(chance.choice(texts))
            if i % 3 == 1:
                words[chance.randrange(len(words))] = f"w{chance.randrange(120)}x"
        texts.append(words)
    return [(i, None if i == 7 else "" if i == 8 else " ".join(w), "xy"[i % 5 == 0]) for i, w in enumerate(texts)]


def counted(rows, group):
    return {i: Counter(w := (t or "").split()) + Counter(map(" ".join, zip(w, w[1:]))) for i, t, g in rows if g == group}


def ranked(own, size):
    freq, df = Counter(), Counter()
    for c in own.values():
        freq.update(c)
        df.update(c.keys())
    return [(t, freq[t], df[t]) for t in sorted(freq, key=lambda t: (-freq[t], t))[:size]]


def pairs(rows, size, least):
    found = set()
    for g in "xy":
        own = counted(rows, g)
        idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, _, n in ranked(own, size)}
        vectors = {}
        for i, c in own.items():
            w = {t: n * idf[t] for t, n in c.items() if t in idf}
            if length := math.sqrt(sum(x * x for x in w.values())):
                vectors[i] = {t: x / length for t, x in w.items()}
        found |= {(a, b) for a in vectors for b in vectors if a < b and round(sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()), 9) > least}
    return found


@pytest.mark.parametrize("buckets", [64, 4096])
def test_terms_of_groups_are_whole_whatever_the_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(T, "BUCKETS", buckets)
    monkeypatch.setattr(T, "ROW", 32)
    words = spark.createDataFrame([(i, t or "", g) for i, t, g in rows()], "id long, words string, label string")
    for size in (1, 25, 2_000):
        assert T.frequent(words, "label", size) == {g: ranked(counted(rows(), g), size) for g in "xy"}


@pytest.mark.parametrize("least", [0.95, 0.6])
def test_pairs_do_not_depend_on_blocks(spark, monkeypatch, least):
    expected = pairs(rows(), 50, least)
    assert len(expected) > 30
    docs = spark.createDataFrame(rows(), "id long, text string, label string")
    for few, rows_of_block in ((1, 1 << 16), (3, 20)):
        for name, value in (("FEW", few), ("ROWS", rows_of_block), ("LEAST", 8)):
            monkeypatch.setattr(N, name, value)
        found = [tuple(r) for r in N.all_pairs(docs, "id", "label", least, 50).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_folded_vectors_lose_no_pair(monkeypatch):
    own = {i: c for i, c in counted(rows(), "x").items() if c}
    terms = [t for t, _, _ in ranked(own, 10_000)]
    known = [sorted((terms.index(t), n) for t, n in c.items()) for c in own.values()]
    same = [bytes([i % 256] * 16) for i in range(len(known))]
    idf = np.ones(len(terms))
    flat = [np.array([x[k] for v in known for x in v], np.int32) for k in (0, 1)]
    chunk = N.packed(N.Block(np.array(list(own)), np.append(0, np.cumsum([len(v) for v in known])), *flat, np.empty(0)), same)
    every = N.unpacked([chunk], idf)
    wide = np.zeros((len(known), len(terms)))
    for i, v in enumerate(known):
        wide[i, [p for p, _ in v]] = [n for _, n in v]
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    keys = list(own)
    expected = {(keys[a], keys[b]) for a in range(len(keys)) for b in range(a + 1, len(keys)) if round(float(wide[a] @ wide[b]), 9) > 0.9}
    for folded, tile in ((256, 1 << 21), (8, 1 << 13), (1, 1 << 13)):
        monkeypatch.setattr(N, "FOLDED", folded)
        monkeypatch.setattr(N, "TILE", tile)
        found = [p for a, b in N.close_rows(every, every, idf, 0.9) for p in zip(a.tolist(), b.tolist())]
        assert len(found) == len(set(found)) and set(found) == expected and expected


def test_dedup_in_rounds_is_in_row_order(spark, monkeypatch):
    for name, value in (("FEW", 3), ("ROWS", 20), ("LEAST", 8)):
        monkeypatch.setattr(N, name, value)
    earlier, gone = {}, set()
    for a, b in pairs(rows(), 50, 0.6):
        earlier.setdefault(b, []).append(a)
    for b in sorted(earlier):
        if any(a not in gone for a in earlier[b]):
            gone.add(b)
    docs = spark.createDataFrame(rows(), "id long, text string, label string")
    kept = {r["id"] for r in N.drop_near(docs, "id", "label", 0.6, 50).collect()}
    assert kept == {i for i, _, _ in rows()} - gone and gone

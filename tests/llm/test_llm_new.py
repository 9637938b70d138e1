"""Phrase mining, fill-in-the-middle texts and the Hamming index against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import catalog, fill_in_middle, hamming_index, phrase_mining

SF = "/root/testdata/sf0.001"
#: Extra columns with names that the operators use themselves.
CLASHING = "doc_id long, text string, lang string, f int, m int, word string, `a.b` int, h int, n int, form string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "w", 3, 4, 5, "psm") for i, t, lang in rows], CLASHING)


def phrases(rows, least, top):
    """What op11's contract says."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in found.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside.get(q, 0), a)
        kept = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= 50 * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


PHRASE_ROWS = [
    *((i, "New York  city\tof New York, New York. the THE the the é\x01 é é\x01 é", "en") for i in range(12)),
    (1, None, "en"), (2, "", None), (None, "one two one two one two one two one two one two", None), (5, "one two " * 9 + "\n" + "one two " * 9, "und"),
    (6, " \t .,;", "fr"), (7, "rare words only once", "de"), (2**60, "a b c " * 5_000, "de"), (9, "x" * 100 + " " + "y" * 70 + " z ", "en"),
    *((20 + i, "x" * 100 + " " + "y" * 70 + " z ", "en") for i in range(10)), *((40 + i, f"tie{i % 3} end{i % 3} " * 4, "fr") for i in range(9)),
]


@pytest.mark.parametrize(("hot_words", "most"), [(200_000, 4_000_000), (3, 50)])
@pytest.mark.parametrize("top", [2_000, 3])
def test_phrases_by_brute_force(spark, monkeypatch, hot_words, most, top):
    monkeypatch.setattr(phrase_mining, "CODES", 100)
    monkeypatch.setattr(phrase_mining, "BUCKET_ROWS", 2)
    found = phrase_mining.mine_phrases(documents(spark, PHRASE_ROWS), top=top, hot_words=hot_words, most_keys=most)
    assert sorted(map(tuple, found.collect())) == phrases(PHRASE_ROWS, 10, top)


def test_no_phrases(spark):
    assert phrase_mining.mine_phrases(documents(spark, [])).collect() == []
    assert phrase_mining.mine_phrases(documents(spark, [(1, "a b c", "en"), (2, None, None)])).collect() == []


def test_long_texts_are_coded_in_chunks(monkeypatch):
    text = "a bb\nc  dd " * 500 + "a"
    whole = phrase_mining.codes_of(text, lambda w: {"a": 1, "bb": 2, "c": 3}.get(w, -1))
    monkeypatch.setattr(phrase_mining, "CHUNK", 7)
    assert phrase_mining.codes_of(text, lambda w: {"a": 1, "bb": 2, "c": 3}.get(w, -1)).tolist() == whole.tolist() == [1, 2, -1, 3, -1] * 500 + [1]


def test_radix_order():
    rng = np.random.default_rng(1)
    for high in (rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 3, 500, dtype=np.uint64), np.empty(0, np.uint64)):
        low = rng.integers(0, 2**32, len(high), dtype=np.uint32)
        assert phrase_mining.radix_order(high, low).tolist() == np.lexsort((low, high)).tolist()


def test_exact_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    row = spark.range(1).select(phrase_mining.score_of(F.lit(big), F.lit(big + 7), F.lit(big + 11)).alias("s")).first()
    assert row.s == 1_000_000 * big * big // ((big + 7) * (big + 11))


FIM_ROWS = [
    (1, "a\x1eb\x1fc\x1fm" * 5, "x"), (2, "", "x"), (3, None, "x"), (None, "😀é\n\r x" * 7, None), (5, "has <P> x", "x"), (6, "<<S<P<M" * 9, "x"),
    (7, "$1\\0$" * 9, "x"), (7, "$1\\0$" * 9, "x"), (8, "long \x1e" * 100_000, "x"), *((i, "<é😀\x1e ab\n"[: i % 8] * 3, "x") for i in range(10, 400)),
]


def test_fill_in_middle_by_brute_force(spark):
    made = fill_in_middle.fill_in_middle(documents(spark, FIM_ROWS))
    forms = Counter()
    for (i, text, _), row in zip(FIM_ROWS, made.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()):
        text = text or ""
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        pre, mid, suf = text[:low], text[low:high], text[high:]
        output = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (row.doc_id, row.n, row.form, row.output, row.back) == (i, len(text), form, output, text)
        assert (row.low, row.high, row.parts) == (None,) * 3 if form == "plain" else (row.low, row.high, tuple(row.parts)) == (low, high, (pre, mid, suf))
        forms[form] += 1
    assert min(forms.values()) > 20
    assert fill_in_middle.fill_in_middle(documents(spark, [])).collect() == []


@pytest.mark.parametrize("unit", ["word", "line"])
def test_fill_in_middle_by_words_and_lines(spark, unit):
    made = fill_in_middle.fill_in_middle(documents(spark, FIM_ROWS), unit)
    parted = {"word": r"[^ \t\n]*[ \t\n]+|[^ \t\n]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    for (_, text, _), row in zip(FIM_ROWS, made.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()):
        units = re.findall(parted, text or "")
        assert (row.n, row.back) == (len(units), text or "")
        if row.form != "plain":
            assert tuple(row.parts) == ("".join(units[: row.low]), "".join(units[row.low : row.high]), "".join(units[row.high :]))


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_fill_in_middle"])
def test_new_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    told = con.execute(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, SF)
    assert found.columns == [x[0] for x in told.description]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, told.fetchall()))


def nearest(rows, k, is_query):
    """The k nearest of each query among all other rows, by cosine."""
    sound = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    sound = [(i, v / np.abs(v).max()) for i, v in sound]
    sound = [(i, v / np.linalg.norm(v)) for i, v in sound]
    out = {}
    for at, (i, v) in enumerate(sound):
        if i is not None and is_query(i):
            others = sorted((-round(float(v @ w), 12), j is None, j or 0) for b, (j, w) in enumerate(sound) if b != at)
            out.setdefault(i, []).append([(None if none else j, -s) for s, none, j in others[:k]])
    return out


def search_rows(found):
    out = {}
    for row in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(row.query_id, []).append((row.vec_id, row.score))
    return out


def test_recall_of_the_index(spark):
    found = search_rows(catalog.QUERIES["op13_hamming_index"](spark, "/root/testdata/sf0.01"))
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    told = nearest([(r.vec_id, r.embedding) for r in table], 5, lambda i: i % 50 == 0)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in lists[0]}) for q, lists in told.items()]
    assert sum(hits) >= 0.9 * 5 * len(told)
    assert all(abs(s - dict(nearest_all)[i]) < 1e-9 for q, lists in told.items() for nearest_all in lists for i, s in found[q] if i in dict(nearest_all))


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    for radius in (0, 7, 8, 20, 33, 64):
        units = hamming_index.unit(rng.normal(size=(400, 32)))
        model = hamming_index.Model(np.zeros(32), np.hstack([hamming_index.learn_rotation(units, 5, s) for s in (0, 1)]), radius)
        shard = hamming_index.Shard(np.arange(400), np.zeros(400, dtype=bool), np.arange(400), units, model)
        codes = hamming_index.codes_of(model, units[:40])
        within = hamming_index.distances(codes, shard.codes) <= radius
        assert (shard.probe(codes) | ~within).all()


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=6).tolist()
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 40)] + [(i, base) for i in range(100, 130)] + [(100, base), (None, base), (50, [x * 1e300 for x in base])]
    odd = [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None] + [0.0] * 4), (204, [float("nan")] * 6), (205, [float("inf")] + [1.0] * 5), (206, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, True) for i, v in rows + odd], "vec_id long, embedding array<double>, row int, shard boolean")
    # Within a radius of all bits the index gives what brute force gives.
    params = hamming_index.IndexParams(aim=1.0, probes=1_000)
    found = hamming_index.search(frame, F.col("vec_id") % 25 == 0, 5, params, shard_rows=20)
    told = nearest(rows, 5, lambda i: i % 25 == 0)
    got = {}
    for row in found.collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, round(row.score, 9)))
    for q, lists in told.items():
        want = sorted((k, i, round(s, 9)) for one in lists for k, (i, s) in enumerate(one, 1))
        assert sorted(got[q]) == want
    assert set(got) == set(told)


def test_small_and_empty_tables_of_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert hamming_index.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    assert hamming_index.search(spark.createDataFrame([(0, [1.0, 2.0])], schema), F.col("vec_id") % 50 == 0).collect() == []
    three = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, -2.0]), (2, [2.0, 4.0])], schema)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in hamming_index.search(three, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, -1.0)]

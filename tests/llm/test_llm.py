"""Training-data operators against brute force, on small fixtures with nulls, ties and long texts."""

import hashlib
import os
import re
from collections import Counter
from importlib.util import find_spec

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe_trie, chat_format, decontaminate, language_id, quality_ratio, sharding, simhash_golay, suffix_array, suffix_dedup, token_rollup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards boil a kettle of green tea near the harbour"
ROWS = [
    (1, BASE, "en"), (2, None, "en"), (3, "", None), (4, BASE, "en"), (5, "prefix words here " + BASE + " and a tail of other words", "fr"),
    (6, "x", "en"), (7, "aaaa " * 60, "de"), (7, "aaaa " * 60, "de"), (None, "no id " + BASE, "en"), (8, "é" * 80 + " 日本 <|endoftext|> \n\n\t b", "fr"),
    (9, "aaaa " * 61 + "b", "de"), (10, "   \n ", "en"), (2**61, "word " * 30_000 + BASE, "en"), (11, "1234 5678 !!!", "es"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_array_sorts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 60))), 0)
        listed = text.tolist()
        assert suffix_array.suffix_array(text, 6).tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])
        assert suffix_array.by_doubling(text).tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])


def removed(rows):
    """What op9's contract says, by brute force."""
    first = {}
    data = [(2**63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                hit[k : k + 50] = True
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((None if i == 2**63 else i, len(b), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    return out


def test_suffix_dedup(docs, empty):
    found = sorted(map(tuple, suffix_dedup.digests(docs).collect()), key=repr)
    assert found == sorted(removed([(i, t) for i, t, _ in ROWS]), key=repr)
    assert suffix_dedup.digests(empty).count() == 0
    kept = suffix_dedup.remove_repeats(docs.withColumn("data", F.lit(1)))
    assert kept.columns == [*docs.columns, "data"] and kept.filter("doc_id = 2 AND text IS NULL").count() == 1


@pytest.mark.parametrize("remembered", [1, 64, 1 << 19])
def test_suffix_dedup_files_a_frequent_key_once_a_task(monkeypatch, remembered):
    monkeypatch.setattr(suffix_dedup, "PIECE", 400)
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 60, np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, 300, np.uint8)).decode() + (passage if i % 2 else "") for i in range(60)]
    texts += [texts[7][:200], texts[8][100:] * 9, ""]
    wanted = {}
    for i, text in enumerate(texts):
        for _, _, starts, data in suffix_dedup.cut([text.encode()]):
            for key in suffix_dedup.records(starts, data)[4].tolist():
                wanted.setdefault(key, set()).add(i)
    wanted = {k: d for k, d in wanted.items() if len(d) > 1}
    # Two tasks, several batches each, three buckets.
    halves = [range(0, 33), range(33, len(texts))]
    frames = lambda part: (pd.DataFrame({"_tw_key": list(part)[k : k + 5], "text": [texts[i] for i in list(part)[k : k + 5]]}) for k in range(0, len(part), 5))
    rows = pd.concat([f for part in halves for f in suffix_dedup.nominate(frames(part), 3, remembered)])
    found: dict[int, set[int]] = {}
    for bucket in range(3):
        for told in suffix_dedup.shared_keys(iter([rows[rows["bucket"] == bucket]])):
            for doc, data in zip(told["doc"], told["data"]):
                for key in suffix_dedup.unpack_keys(data).tolist():
                    found.setdefault(key, set()).add(int(doc))
    assert found == wanted
    sent = [suffix_dedup.unpack_keys(x[4 + 12 * int.from_bytes(x[:4], "little") :]) for x in rows.loc[~rows["direct"], "data"]]
    hot = max(wanted, key=lambda k: len(wanted[k]))
    assert len(wanted[hot]) >= 30
    if remembered > 64:
        assert int((np.concatenate(sent) == np.uint64(hot)).sum()) == 2


def test_suffix_dedup_of_a_hot_anchor(spark, docs):
    found = sorted(map(tuple, suffix_dedup.digests(docs, most_records=1).collect()), key=repr)
    assert found == sorted(removed([(i, t) for i, t, _ in ROWS]), key=repr)
    # One passage between texts of their own: the records at its edges all differ.
    own = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    rows = [(i, f"{x} {BASE} {x[::-1]}") for i, x in enumerate(own)] + [(None, own[7]), (7, own[8])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.digests(table, most_records=20).collect()), key=repr) == sorted(removed(rows), key=repr)
    # No task holds more records of a key than the bound.
    packed = [suffix_dedup.pack_records([np.array([i]), np.array([i]), np.array([0]), np.array([5 if i % 3 else i]), np.array([0]), np.array([50])], [b"x" * 50]) for i in range(90)]
    held: list = []
    batch = lambda part: suffix_dedup.frame([(0, None, x) for x in part], "shard")
    away = list(suffix_dedup.set_apart((batch(packed[k : k + 9]) for k in range(0, 90, 9)), 2, 10, held))
    assert sum(len(content) for _, content in held) == 30
    moved = [x for frame in away for x in frame["data"]]
    assert sum(len(suffix_dedup.read_records(x)[1]) for x in moved) == 60 and {b for f in away for b in f["bucket"]} == {-1, -2}


def test_simhash_components(docs, empty):
    xx = simhash_golay.xxhash
    assert simhash_golay.fingerprint("A b") == xx.xxh64_intdigest(b"a b", 42) and simhash_golay.fingerprint(None) == 0
    rows = simhash_golay.classes(docs).collect()
    prints = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    ids = [2**63 if r["doc_id"] is None else r["doc_id"] for r in rows]
    least = list(ids)
    for _ in rows:
        for i in range(len(rows)):
            least[i] = min(least[j] for j in range(len(rows)) if np.bitwise_count(prints[i] ^ prints[j]) <= 4)
    assert [None if x == 2**63 else x for x in least] == [r["component_id"] for r in rows]
    assert simhash_golay.classes(empty).count() == 0


def test_near_copies_keep_one_row_of_each_class(spark, docs):
    alone, other = "only here and without an id " * 9, "a second text of its own that no other document has " * 3
    odd = [
        (None, alone, "en"), (None, None, "en"), (None, "", "fr"),  # classes without any id
        (20, other, "en"), (20, other, "en"), (20, other, "de"), (21, other, "en"),  # repeated rows, one with another label
        (20, BASE, "en"),  # shares an id with the first row of another class
    ]
    rows = [(i, t, lang, "s", 0) for i, t, lang in odd]
    kept = sorted(map(tuple, simhash_golay.keep_first(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert len(kept) == 4 and rows[0] in kept and (20, BASE, "en", "s", 0) in kept
    assert sum(r[1] == other and r[0] == 20 for r in kept) == 1 and sum(not r[1] for r in kept) == 1
    # Exactly one row of each class, of its smallest doc_id.
    every = simhash_golay.keep_first(docs)
    found = {(r["fingerprint"], r["component_id"]) for r in simhash_golay.classes(every).collect()}
    assert every.count() == len(found) == len({r["component_id"] for r in simhash_golay.classes(docs).collect()})


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for bits in range(5):
        flips = np.array([sum(1 << int(k) for k in rng.choice(64, bits, replace=False)) for _ in base], np.uint64)
        shared = [set(), set()]
        for side, fps in enumerate((base, base ^ flips)):
            place, key = simhash_golay.keys_of(fps)
            shared[side] = set(zip(place.tolist(), key.tolist()))
        assert len({p for p, _ in shared[0] & shared[1]}) == len(base)


def test_links_of_a_large_block():
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(7) ^ np.array([sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(1500)], np.uint64))
    left, right = simhash_golay.links_within(fps)
    assert (np.bitwise_count(fps[left] ^ fps[right]) <= 4).all() and len(left) < len(fps)


def test_bpe_is_the_librarys(docs):
    from tokenizers import Tokenizer

    path = bpe_trie.default_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [t or "" for _, t, _ in ROWS]
    expected = library.encode_batch(texts, add_special_tokens=False)
    assert sorted(r["token_ids"] for r in bpe_trie.encode(docs, path).collect()) == sorted(e.ids for e in expected)
    told = {(r["n_tokens"], r["decoded_sha256"]) for r in bpe_trie.digests(docs, path).collect()}
    assert told == {(len(e.ids), hashlib.sha256(t.encode()).hexdigest()) for e, t in zip(expected, texts)}


def test_quality_base_rules(docs, spark, empty):
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    params = quality_ratio.QualityParams()
    model = quality_ratio.fit(docs, trusted, params)
    rows = {r["n_words"]: r for r in quality_ratio.judge(docs, model, params).collect()}
    for _, text, _ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        row = rows[len(words)]
        assert row["word_chars"] == sum(map(len, words)) and row["n_repeat_words"] == len(covered)
        assert row["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert quality_ratio.judge(empty, quality_ratio.fit(empty, trusted, params), params).count() == 0


def test_decontamination_of_odd_rows(docs, spark, empty):
    items = spark.createDataFrame([(1, BASE), (1, BASE), (2, "x"), (None, "aaaa aaaa aaaa"), (3, None), (4, "..")], "item_id long, text string")
    rows = decontaminate.find_hits(docs, items).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["item_ids"] == ["1"] and by[6]["item_ids"] == ["2"] and by[2]["spans"] == [] and by[7]["item_ids"] == []
    clean = decontaminate.decontaminate(docs, items, most_hit_share=0.9)
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left[5] == "prefix words here and a tail of other words" and left[8] == ROWS[9][1] and 1 not in left
    assert decontaminate.find_hits(docs, items.limit(0)).count() == len(ROWS) and decontaminate.find_hits(empty, items).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "<next> \\l <"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\\"), (1, 3, "assistant", "b"), (2, 0, None, ""), (None, 0, "assistant", "ä>")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat_format.format_conversations(table).select(
        "conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m"), "formatted"
    )
    found = {r["conv_id"]: r for r in rows.collect()}
    assert [tuple(t) for t in found[1]["t"]] == [("user", "<next> \\l <"), ("user", ""), ("assistant", "</turn>\\"), ("assistant", "b")]
    assert found[1]["m"] == "</turn>\\b" and found[1]["formatted"].count("</turn>") == 2
    assert [tuple(t) for t in found[2]["t"]] == [("", "")] and found[None]["m"] == "ä>"
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def test_shards_keep_the_key_law(docs, empty):
    rows = sharding.assign(docs, [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == len(ROWS) and all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {1} and sharding.assign(empty, [1.0], [1.0, 1.0]).count() == 0


def test_shards_follow_weights(spark):
    key = sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0])
    counts = {r[0]: r[1] for r in spark.range(20_000).groupBy(key.alias("s")).count().collect()}
    assert set(counts) == {0, 1} and abs(counts[1] / 20_000 - 0.75) < 0.02


def test_language_model(spark, docs):
    table = "/root/testdata/sf0.01"
    rows = language_id.op1_language_id(spark, table).join(spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = language_id.fit(language_id.learn_from(spark.read.parquet(f"{table}/documents.parquet")), language_id.LanguageParams())
    judged = language_id.predict(docs, model, 0.1).collect()
    assert [r["lang_pred"] == "und" for r in judged] == [not re.search(r"[^\W\d_]", t or "") for _, t, _ in ROWS]
    long = "straße " * 700_000
    assert np.allclose(language_id.gram_counts([long], 4096).sum(), 2 * 8 * 700_000 - 2 * 700_000, rtol=0.01)


def test_language_rejection(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.learn_from(table), language_id.LanguageParams())
    rng = np.random.default_rng(5)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (900, 2000, 5000)]
    finnish = (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokaisella on oikeus elämään, vapauteen ja turvallisuuteen. "
    )
    foreign = [*junk, finnish, finnish * 4]
    told = language_id.predict(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model, 0.1)
    assert all(r["rejected"] for r in told.collect())
    kept = language_id.predict(table.filter(language_id.held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")), model, 0.1)
    assert kept.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.05
    # Document frequencies are those of all rows.
    few = language_id.fit(language_id.learn_from(table), language_id.LanguageParams(per_language=50))
    assert np.array_equal(few.idf, model.idf)


def test_url_rules(spark):
    urls = ["http://a.NET/x", "https://m.example.net/en/1?q", "http://example.net/en", "http://x.example.com/de/1", "http://org/fr/1", "http://xorg/fr/1", "nothing", None, "http://a.net", "ftp://b.org?x=/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [rows[i]["rule"] for i in range(len(urls))] == ["net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None]
    assert rows[0]["host"] == "a.net" and rows[7]["host"] == "" and rows[9]["host"] == "b.org" and rows[9]["path"] == ""
    assert {r["verdict"] for r in rows.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_rollup_is_idempotent(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    change = lambda *rows: spark.createDataFrame(list(rows), "source string, lang string, tokenizer_version string, n_tokens long, sign int")
    assert rollup.totals().count() == 0
    assert rollup.apply(0, change(("a", "en", "1", 5, 1), ("a", "en", "1", 7, 1), (None, None, "1", None, None)))
    assert rollup.apply(1, change(("a", "en", "1", 5, -1), ("a", "en", "1", 6, 1))) and not rollup.apply(1, change(("a", "en", "1", 9, 1)))
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == [("a", "en", "1", 2, 13), (None, None, "1", 1, 0)]


@pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100

"""Training-data operators on hot keys, clashing names, missing labels and very long input, against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter
from importlib.util import find_spec

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import bpe_trie, chat_format, common, components, decontaminate, language_id, quality_ratio, sharding, simhash_golay, suffix_dedup, token_rollup, url_filter

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = " ".join(f"word{i} of{i}" for i in range(12))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Language


def test_language_without_labels(spark):
    rows = [(1, "some words here", None), (2, "1234", "en"), (3, None, "en"), (None, "more words", "en"), (4, "!", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for docs in (table, table.limit(0)):
        model = language_id.fit(language_id.learn_from(docs), language_id.LanguageParams())
        assert model.languages == []
        told = language_id.predict(docs, model, 0.1).collect()
        assert {r["lang_pred"] for r in told} <= {"und"} and {r["score"] for r in told} <= {0.0}
        assert [r["rejected"] for r in told] == [not re.search("[a-z]", r["text"] or "") for r in told]


def test_grams_are_those_of_each_text_alone():
    texts = ["straße und wort", "", "a", "x" * 9, "zwei wörter"]
    together = language_id.gram_counts(texts, 4096)
    for text, row in zip(texts, together):
        assert np.array_equal(language_id.gram_counts([text], 4096)[0], row)
    assert together[2].sum() == 2 and not together[1].any()  # " a" and " a "
    long = "straße " * 400_000
    cut = language_id.gram_counts([long], 4096)[0]
    assert np.array_equal(cut, np.asarray(language_id.gram_counts(["straße " * 1000], 4096)[0]) * 400)


# Token counts


def test_rollup_counts_each_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "FOLD", 3)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    change = lambda *rows: spark.createDataFrame(list(rows), "source string, lang string, tokenizer_version string, n_tokens long, sign int, extra string")
    assert rollup.apply(3, change().limit(0)) and rollup.totals().count() == 0
    row = ("a", "en", "1", 5, 1, "x")
    assert rollup.apply(5, change(row, row)) and rollup.apply(9, change(row)) and not rollup.apply(5, change(row))
    before = rollup.totals()
    # A late batch is no repeat.
    assert rollup.apply(4, change(row)) and not rollup.apply(4, change(row)) and not rollup.apply(9, change(row))
    assert sorted(map(tuple, rollup.totals().collect())) == [("a", "en", "1", 4, 20)]
    assert sorted(r[0] for r in rollup.committed().collect()) == [3, 4, 5, 9]
    # A reader that began before goes on; totals of older steps are gone.
    assert sorted(map(tuple, before.collect())) == [("a", "en", "1", 3, 15)]
    assert sorted(p.name for p in (tmp_path / "r" / "totals").iterdir()) == ["step=2", "step=3", "step=4"]
    # A batch that broke off before its commit is done again.
    change(("b", "en", "1", 1, 1, "")).write.parquet(str(tmp_path / "r" / "totals" / "step=5"))
    assert rollup.totals().count() == 1 and rollup.apply(10, change(("b", "en", "1", 2, 1, "")))
    assert {r["source"]: r["n_tokens"] for r in rollup.totals().collect()} == {"a": 20, "b": 2}


# URLs


def test_a_hot_url_does_not_fill_the_sample(spark):
    rows = ["http://hot.net/x"] * 400 + [f"http://m{i}.org/fr/{i}" for i in range(300)] + [f"http://m{i}.net/{i}" for i in range(300)]
    others = [f"http://n{i}.org/de/{i}" for i in range(50)]
    pages = spark.createDataFrame([(i, u, 0.5, "r") for i, u in enumerate(rows + others)], "page_id long, url string, f_suffix double, rule string")
    told = {r["page_id"]: r for r in url_filter.judge(pages, params=url_filter.UrlParams(sample=50)).collect()}
    assert len(told) == len(rows) + 50
    assert all(told[len(rows) + i]["rule"] is None and told[len(rows) + i]["verdict"] == "allow" for i in range(50))
    assert all(told[i]["verdict"] == "block" and told[i]["rule"] == "net/" for i in range(400))
    # One label alone, and none.
    one = url_filter.judge(pages.filter("url LIKE '%.net%' OR page_id >= 1000")).collect()
    assert {r["p_block"] for r in one} == {1.0}
    assert {r["verdict"] for r in url_filter.judge(pages.filter("page_id >= 1000")).collect()} == {"allow"}


def test_trees_judge_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = pages.withColumn("host", url_filter.host_of(F.col("url"))).withColumn("path", url_filter.path_of(F.col("url")))
    verdict = url_filter.rule_for(F.col("host"), F.col("path"), url_filter.RULES, "verdict")
    labelled = ruled.withColumn("verdict", verdict).filter("verdict IS NOT NULL").select("url", (F.col("verdict") == "block").cast("int").alias("block"))
    test = F.pmod(F.xxhash64("url", F.lit("test")), F.lit(3)) == 0
    model = url_filter.UrlModel(labelled.filter(~test), url_filter.UrlParams())
    told = model.verdict(url_filter.with_features(labelled.filter(test))).select("block", (F.col("p_block") >= 0.5).cast("int").alias("told")).collect()
    both = sum(r["block"] and r["told"] for r in told)
    assert len(told) > 100 and both / sum(r["told"] for r in told) > 0.9 and both / sum(r["block"] for r in told) > 0.9


# Shards


def test_shards_by_brute_force(spark):
    rows = [(i % 7 if i % 5 else None, f"text {i % 11}" if i % 13 else None) for i in range(300)] + [(1, "same")] * 200
    table = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(tuple, sharding.assign(table, [1.0] * 4, [1.0] * 5).collect()), key=repr)
    again = sorted(map(tuple, sharding.assign(table.repartition(9), [1.0] * 4, [1.0] * 5).collect()), key=repr)
    assert first == again
    assert Counter((i, s, c) for i, s, c, *_ in first) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in range(4):
        slots = sorted(r[5] for r in first if r[4] == shard)
        assert slots == list(range(len(slots)))
    assert len({(r[0], r[4], r[6]) for r in first}) == len({r[0] for r in first})


# Quality


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality_verdicts_by_brute_force(spark, documents, texts):
    params = quality_ratio.QualityParams()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
    n = params.n_buckets
    grams = {}
    for i, text in texts.items():
        w = WORDS.findall(text or "")
        grams[i] = [spark_hash(x) % n for x in w] + [spark_hash(x, y) % n for x, y in zip(w, w[1:])]
    corpus, target = np.zeros(n), np.zeros(n)
    for i, found in grams.items():
        np.add.at(corpus, found, 1)
        if i in good:
            np.add.at(target, found, 1)
    ratio = np.log((target + 1) / (target.sum() + n)) - np.log((corpus + 1) / (corpus.sum() + n))
    rows = quality_ratio.op5_quality_ratio(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        w = WORDS.findall(text)
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        base = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed
        assert base == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        if w:
            llr = ratio[grams[r["doc_id"]]].sum() / (2 * len(w) - 1)
            assert abs(llr - r["llr"]) < 1e-6
            if abs(llr - params.least_ratio) > 1e-6:
                assert r["kept"] == (not failed and llr >= params.least_ratio)
        else:
            assert r["llr"] is None and not r["kept"]


def test_quality_verdicts_follow_the_text_alone(spark):
    table = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven " + "x" * (i % 3), 1) for i in range(30)], "doc_id long, text string, llr int")
    params = quality_ratio.QualityParams()
    rows = quality_ratio.judge(table, quality_ratio.fit(table, table.filter("doc_id < 5"), params), params).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"] % 3, set()).add((r["kept"], round(r["llr"], 9)))
    assert len(rows) == 30 and all(len(v) == 1 for v in by_text.values())
    # A ratio that equals the threshold is kept: a corpus that is all trusted has ratios of 0.
    even = quality_ratio.QualityParams(least_ratio=0.0)
    assert all(r["kept"] for r in quality_ratio.judge(table, quality_ratio.fit(table, table, even), even).collect())


# Benchmark


def hits_by_hand(text, items):
    w = ITEM_WORDS.findall(lowered(text))
    hit, found = set(), set()
    for i, t in items:
        own = ITEM_WORDS.findall(lowered(t))
        n = min(10, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_both_ways_of_decontamination_by_brute_force(spark):
    items = [(1, PASSAGE), (2, "short one"), (None, "no id here"), (3, None), (4, PASSAGE + " and more"), (1, PASSAGE)]
    texts = [PASSAGE, f"before {PASSAGE} after", None, "", "a short one, and NO ID here", "x " * 3000 + PASSAGE + " y" * 3000, "short one " * 400, PASSAGE]
    docs = spark.createDataFrame([(i, t, i, 0.0, 1) for i, t in enumerate([*texts, "short one " * 400])], "doc_id long, text string, w int, h double, `row` int")
    # Columns by the names of the operator's own.
    docs = docs.withColumns({c: F.lit(c) for c in ("len", "gram", "item_id", "items", "spans", "n_words", "id", "k1", "at", "hit", "slice", "a.b")})
    table = spark.createDataFrame(items, "item_id long, text string")
    for most in (0, None):
        found = {r["doc_id"]: r for r in decontaminate.find_hits(docs, table, most_broadcast=most).withColumn("n", decontaminate.covered_words(F.col("spans"))).collect()}
        for i, text in enumerate(texts):
            assert hits_by_hand(text, items) == (found[i]["n_words"], found[i]["n"], found[i]["item_ids"]), (most, i)
        clean = decontaminate.decontaminate(docs, table, most_hit_share=0.95, most_broadcast=most)
        left = {r["doc_id"]: r["text"] for r in clean.collect()}
        assert clean.columns == docs.columns and set(left) == {1, 2, 3, 4, 5}
        assert left[1] == "before after" and left[2] is None and left[4] == "a, and" and left[5] == ("x " * 3000 + " y" * 3000).replace("  ", " ")
        assert decontaminate.find_hits(docs.limit(0), table, most_broadcast=most).count() == 0


# Chat


def test_long_conversations_and_clashing_names(spark):
    said = [("user" if i % 3 else "assistant", f"t{i} <b>") for i in range(4000)]
    table = spark.createDataFrame([(1, i, r, t, "x", 2) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string, turns string, pieces int")
    row = chat_format.format_conversations(table).select(
        chat_format.parse(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m"), F.size("loss_mask").alias("n")
    ).first()
    assert [tuple(x) for x in row["t"]] == said
    assert row["m"] == "".join(t for r, t in said if r == "assistant") and row["n"] == sum(r == "assistant" for r, _ in said)
    sums = spark.range(1).select(*(chat_format.running_sums(F.lit(list(range(n))) if n else F.array().cast("array<int>")).alias(f"s{n}") for n in (0, 1, 2, 7, 33))).first()
    assert [list(x) for x in sums] == [np.cumsum(range(n)).tolist() for n in (0, 1, 2, 7, 33)]


# Tokens


def test_a_very_long_word_takes_linear_memory():
    import tracemalloc

    from tokenizers import Tokenizer

    path = bpe_trie.default_vocabulary()
    ours, library = bpe_trie.TrieEncoder(bpe_trie.read_spec(path)), Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    letters = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 60_000)))
    words = [letters, letters[:30_000] + "abc", "a" * 20_000, letters[:200]]
    expected = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in ours.encode(words)] == expected
    ours.forget()
    tracemalloc.start()
    ours.encode([letters[:20_000]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_words_share_the_trie(monkeypatch):
    ours = bpe_trie.TrieEncoder(bpe_trie.read_spec(bpe_trie.default_vocabulary()))
    alone = bpe_trie.TrieEncoder(bpe_trie.read_spec(bpe_trie.default_vocabulary()))
    ours.encode(["prefixed"])
    assert len(ours.last_token) == 1 + len("prefixed")
    assert ours.encode(["prefixing"]) == alone.encode(["prefixing"]) and len(ours.last_token) == 1 + len("prefixed") + len("ing")
    monkeypatch.setattr(bpe_trie, "MOST_NODES", 5)
    texts = ["many small words that do not fit", "fit many small wordings"]
    assert ours.encode(texts) == alone.encode(texts)


def test_encoded_rows_with_clashing_names(spark):
    docs = spark.createDataFrame([(None, "ab <|endoftext|> cd", "x", 1), (2, None, "y", 2)], "doc_id long, text string, token_ids string, same int")
    rows = bpe_trie.encode(docs, bpe_trie.default_vocabulary()).collect()
    assert [r["same"] for r in rows] == [True, True] and rows[1]["token_ids"] == []


# Suffix arrays


def test_suffix_dedup_keeps_large_ids_and_other_columns(spark):
    shared = "s" * 20 + "passage that several of the documents have in common, long enough" + "e" * 20
    rows = [(2**61 + 1, "x" + shared, 2**60 + 3, "a"), (None, "y" + shared, None, "b"), (2**63 - 1, "z" + shared, 7, None), (5, shared, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, told long, doc string").withColumns({c: F.lit(1) for c in ("bucket", "shard", "data", "h", "g", "key")})
    kept = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert {i: (r["text"], r["told"], r["doc"]) for i, r in kept.items()} == {
        2**61 + 1: ("x", 2**60 + 3, "a"), None: ("y", None, "b"), 2**63 - 1: ("z", 7, None), 5: (shared, None, None)
    }
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(docs).collect()} == {2**61 + 1: len(shared), None: len(shared), 2**63 - 1: len(shared), 5: 0}


# SimHash


def plain_fingerprint(text):
    w = WORDS.findall(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_brute_force(texts):
    odd = [None, "", " \n", "one", "A b\tC", "é ü x y z", "a a a a a a", "w " * 70_000]
    for text in [*odd, *list(texts.values())[:60]]:
        assert simhash_golay.fingerprint(text) == plain_fingerprint(text)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = np.random.default_rng(8)
    edges = [(0, i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (80, 2))] + [(7, 300), (300, 301)]
    found = {r["node"]: r["least"] for r in components.least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    roots = {x: root(x) for x in parent}
    assert {x: found.get(x, x) for x in roots} == roots
    assert components.least_reachable(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaaabbc")], "k string, i int")
    keyed = spark.createDataFrame([("a", 7, 1), ("b", 2, 2), ("c", 1, 3)], "k string, _n long, v int")
    assert sorted(map(tuple, common.join_counted(rows, keyed, "k", 10).collect())) == sorted((k, i, "abc".index(k) + 1) for i, k in enumerate("aaaaaaabbc"))


@pytest.mark.parametrize("longest", [50_000, 2])
def test_classes_of_hot_fingerprints(spark, texts, monkeypatch, longest):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(simhash_golay, "LONGEST_RUN", longest)
    rows = [(i, t) for i, t in texts.items()] + [(1000 + i, "copies of one text that is very frequent here") for i in range(50)]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_golay.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = [i for i, _ in rows]
    prints = np.array([simhash_golay.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    least = np.array(ids)
    while True:
        now = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (now == least).all():
            break
        least = now
    assert found == {i: (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, least)}


# Pipeline


def without_repeats(rows):
    """The texts of (id, text) without their 50-byte strings that start in a text with a smaller id."""
    first = {}
    for i, t in sorted(rows):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


@pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_by_plain_python(spark, documents, texts):
    from tokenizers import Tokenizer

    import corpus_pipeline

    model = language_id.fit(language_id.learn_from(documents), language_id.LanguageParams())
    ids = sorted(texts)
    languages, scores, needed = model.predict([texts[i] or "" for i in ids])
    known = [i for i, lang, s, n in zip(ids, languages, scores, needed) if lang != "und" and s >= max(n, 0.1)]
    prints = {i: simhash_golay.fingerprint(texts[i]) for i in known}
    group = {i: i for i in known}
    for _ in known:
        before = dict(group)
        for i in known:
            group[i] = min(group[j] for j in known if (prints[i] ^ prints[j]).bit_count() <= 4)
        if group == before:
            break
    left = {i: t for i, t in without_repeats([(i, texts[i]) for i in known if group[i] == i]).items() if t.strip(" ")}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {i: hits_by_hand(t, items) for i, t in left.items()}
    kept = {i for i, (n, n_hit, _) in hits.items() if n_hit <= 0.2 * n}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    clean = {i for i in kept if not hits[i][1]}
    assert clean <= set(rows) <= kept and all(r["same"] for r in rows.values())
    library = Tokenizer.from_file(bpe_trie.default_vocabulary())
    for i in clean:
        assert rows[i]["token_ids"] == library.encode(left[i], add_special_tokens=False).ids
    for i in set(rows) - clean:
        # Cut texts hold no window of an item any more, and words of the text alone.
        text = library.decode(rows[i]["token_ids"], skip_special_tokens=False)
        assert len(ITEM_WORDS.findall(lowered(text))) == hits[i][0] - hits[i][1]


@pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_stages_keep_what_they_should(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t: (i, t, None, "s", 0)
    own = [" ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(8)) for k in range(4)]
    docs = spark.createDataFrame([row(1, own[0]), row(None, own[1]), row(None, own[2]), row(3, own[0]), row(3, own[3]), row(4, None), row(5, "12 34")], schema)
    texts_of = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()), key=repr)
    # Without labels nothing is rejected but what has no letter.
    unjudged = stages["language_id"](spark, docs, SMALL)
    assert texts_of(unjudged) == sorted([(1, own[0]), (0, own[1]), (0, own[2]), (3, own[0]), (3, own[3])], key=repr)
    near = stages["simhash_near_dedup"](spark, docs, SMALL)
    assert {t for _, t in texts_of(near)} >= set(own) and sum(t == own[0] for _, t in texts_of(near)) == 1
    repeats = stages["suffix_dedup"](spark, unjudged, SMALL)
    assert texts_of(repeats) == sorted([(1, own[0]), (0, own[1]), (0, own[2]), (3, own[3])], key=repr)
    assert texts_of(stages["decontamination"](spark, repeats, SMALL)) == texts_of(repeats)
    encoded = stages["bpe"](spark, repeats, SMALL)
    assert encoded.count() == 4 and encoded.filter("NOT same").count() == 0


# Columns of any name, and sizes at which the square of a length would show


def test_stages_give_other_columns_back(spark):
    text = "Un texte de quelques mots en français pour la langue et encore des mots qui suivent. "
    names = ["score", "lang_pred", "rejected", "null", "row", "k1", "k2", "n", "h", "fp", "name", "_tw_key", "_tw_id", "_tw_first", "_tw_spans", "bucket", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, text + f"Numéro {i}, " + " ".join(f"mot{i}x{k}" for k in range(30)), "fr", "s", 0, {"t": i}, *(f"{n} {i}" for n in names)) for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:1], schema)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_repeats):
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        told = {r["doc_id"]: r for r in kept.collect()}
        assert len(told) == 20
        for i, r in told.items():
            assert r["tags"] == {"t": i} and [r[n] for n in names] == [f"{n} {i}" for n in names]
    # Rows that differ in a map alone are two rows; of fully equal ones one is left.
    assert simhash_golay.keep_first(docs).count() == 20


def seconds(work):
    start = time.time()
    work()
    return time.time() - start


def test_long_conversations_take_linear_time(spark):
    def read_back(n):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text <of> turn ', id) AS text")
        made = chat_format.format_conversations(turns)
        return made.select(F.char_length(chat_format.masked_text(F.col("formatted"), F.col("loss_mask"))).alias("n")).collect()

    read_back(100)
    short, long = seconds(lambda: read_back(8_000)), seconds(lambda: read_back(32_000))
    assert long < 8 * short + 1


def test_documents_of_hits_take_linear_time(spark):
    words = [f"w{i}" for i in range(64_000)]
    items = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")

    def clean(n):
        docs = spark.createDataFrame([(i, f"some few words {i}") for i in range(300)] + [(999, " ".join(words[:n]))], "doc_id long, text string")
        assert decontaminate.decontaminate(docs, items).count() == 300

    clean(100)
    short, long = seconds(lambda: clean(16_000)), seconds(lambda: clean(64_000))
    assert long < 8 * short + 1


def test_many_labels_share_the_sample(spark):
    rows = [(i, f"label number {i % 300} has words like ab{i % 300}cd{i % 300}ef " * 3, f"l{i % 300:03}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.LanguageParams(per_language=3, most_rows=400, clusters=1))
    assert len(model.centroids) <= 400


def test_long_runs_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)], np.uint64)
    fps = np.unique(base[rng.integers(0, 3, 400)] ^ flips)
    monkeypatch.setattr(simhash_golay, "LONGEST_RUN", 5)
    found = simhash_golay.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    pairs = np.array([(r["a"], r["b"]) for r in found], np.int64).view(np.uint64)
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 4).all()
    place = {int(f): i for i, f in enumerate(fps)}
    left, right = (np.array([place[int(x)] for x in pairs[:, k]]) for k in (0, 1))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    # As many ties as all links together make.
    assert len(simhash_golay.forest(fps, left, right)[0]) == len(simhash_golay.forest(fps, i, j)[0])

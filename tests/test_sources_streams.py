"""File scans, sinks, streams and rule cases."""

from pyspark.sql import functions as F

from tidewater.operators import rules
from tidewater.sources import files
from tidewater.streaming import alerts


def test_registry_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Message,Label\n"hi, you",ham\n" ",spam\nnan,spam\n')
    (tmp_path / "b.tsv").write_text('spam\tit is "free\nham\tok\n')
    (tmp_path / "c.json").write_text('[{"content": "x", "lang": "en"}, {"content": null, "lang": "en"}]')
    specs = [
        files.FileSpec("a", f"{tmp_path}/a.csv", default_language="en"),
        files.FileSpec("b", f"{tmp_path}/b.tsv", text=["_c1"], label=["_c0"], separator="\t", header=False),
        files.FileSpec("c", f"{tmp_path}/c.json", language=["lang"], format="json"),
        files.FileSpec("gone", f"{tmp_path}/gone.csv"),
        files.FileSpec("bare", f"{tmp_path}/a.csv", text=["nothing"]),
    ]
    found = sorted(map(tuple, files.scan_registry(spark, specs).collect()), key=str)
    assert found == sorted([("hi, you", "ham", "en", "a"), ('it is "free', "spam", None, "b"), ("ok", "ham", None, "b"), ("x", "unknown", "en", "c")], key=str)
    assert [r["text"] for r in files.scan_registry(spark, specs, need_label=True).filter("source_dataset = 'c'").collect()] == []


def test_tolerant_lines_and_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.csv").write_text("ham\ta\tb\nno tab\n")
    assert {tuple(r) for r in files.scan_tolerant(spark, f"{tmp_path}/sub/x.csv").collect()} == {("ham", "a\tb"), (None, "no tab")}
    row = files.inventory(spark, str(tmp_path)).collect()
    assert [(r["n_lines"], r["header"]) for r in row] == [(2, "ham\ta\tb")]
    assert files.discover(spark, str(tmp_path)).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "uz"), ("b", "en"), ("c", "de"), (None, "en")], "text string, language string")
    files.write_by_language(rows, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").glob("language=*")) == ["language=en", "language=uz"]
    whole = files.checksum(rows).first()
    assert whole == files.checksum(rows.orderBy(F.desc("language")).repartition(3)).first()
    assert whole != files.checksum(rows.fillna("")).first()
    assert files.checksum(rows.limit(0)).first()["n_rows"] == 0


def streamed(spark, tmp_path, rows, build):
    rows.write.parquet(f"{tmp_path}/in")
    stream = build(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert query.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()


def test_limit_against_plain_python(spark, tmp_path):
    cases = [(i, f"u{i % 3}" if i % 7 else None, i * 1700 if i % 11 else None) for i in range(60)]
    rows = spark.createDataFrame(cases, "id long, who string, ms long")
    rows = rows.withColumn("ts", F.timestamp_millis("ms"))
    found = streamed(spark, tmp_path, rows, lambda s: alerts.limit_alerts(s, "who", "id", (2, 15_300)))
    told, last = {}, {}
    for i, who, ms in cases:
        recent = [t for t in last.get(who, []) if ms is not None and ms - t <= 15_300]
        told[i] = ms is not None and len(recent) < 2
        if ms is not None:
            last[who] = recent + [ms] * told[i]
    assert {r["id"]: r["accepted"] for r in found} == told


def test_repeats_within_time_to_live(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 60), ("b", 30)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["k"] for r in streamed(spark, tmp_path, rows, lambda s: alerts.drop_repeats(s, ["k"]))) == ["a", "b"]


def test_parts_and_blank_messages(spark):
    parts = spark.createDataFrame([(1, 2, "b ", "x"), (1, 1, " a", "x"), (2, 1, " ", "y"), (3, 1, "c", None)], "message_id long, part int, body string, sender string")
    assert {tuple(r) for r in alerts.joined_parts(parts).collect()} == {(1, "ab", "x"), (3, "c", "Unknown")}


def test_rules_on_nulls_and_lexicon(spark):
    small = {"prize_bait": ("win big", "sovrin yutdi"), "suspicious_link": ("t.me",), "greeting": ("salom", "привет")}
    kinds = "signals array<string>, intent string, text string, " + ", ".join(f"{f} boolean" for f in ("link", "suspicious_tld", "malicious_file", "double_extension", "has_file"))
    row = rules.judge(spark.createDataFrame([(None,) * 8], kinds), ("x",)).first()
    assert (row["hard_threat"], row["pattern_keys"], row["pattern_floor"]) == (False, [], 0)
    texts = spark.createDataFrame([("you w in b.ig",), ("go t.me",), ("got me",), ("",), (None,)], "text string")
    got = [r[0] for r in texts.select(rules.match_lexicon(F.col("text"), small)).collect()]
    assert got == [["prize_bait"], ["suspicious_link"], ["suspicious_link"], [], []]

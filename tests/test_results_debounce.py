"""Result texts, chat posts and their merging, on small cases."""

from pyspark.sql import functions as F

from test_sources_streams import streamed
from tidewater.functions import results as X
from tidewater.streaming import debounce

POST = "id long, ms long, package string, sender string, title string, notification_key string, post_ms long, parts array<string>, caption string, file string, urls array<string>"

#: The watermark starts at 0, so cases don't.
START = 1_000_000


def post(id_, ms, sender="a", parts=(), key=None, file=None, post_ms=None):
    return (id_, ms, "app", sender, "t", key, ms if post_ms is None else post_ms, list(parts), None, file, None)


CASES = [
    post(1, 0, parts=["hello"]),
    post(2, 1000, parts=["hello there"]),  # one text within the other: merges, the entry still ends at 1500
    post(3, 1499, parts=["There"]),
    post(4, 1500, parts=["hello"]),  # the entry was closed
    post(5, 1600, parts=["other"]),  # a different message closes the one at 1500
    post(6, 1700, parts=["unlike"], key="k"),
    post(7, 1800, parts=["none"], key="k"),  # the same notification
    post(8, 200, sender="b", parts=["x"], file="A.apk"),
    post(9, 300, sender="b", parts=["y"], file="a.APK"),  # the same file
    post(10, 400, sender="b", parts=["y"], file="a.apk", post_ms=9000),  # too far apart
    post(11, 100, sender=None),
    (12, None, None, None, None, None, None, None, None, None, None),
    (13, 50, None, None, None, None, None, None, None, None, None),
]
WANTED = {
    ("a", 0, 3, ("hello", "hello there", "There")),
    ("a", 1500, 1, ("hello",)),
    ("a", 1600, 1, ("other",)),
    ("a", 1700, 2, ("unlike", "none")),
    ("b", 200, 2, ("x", "y")),
    ("b", 400, 1, ("y",)),
    ("app", 100, 1, ()),
    ("", 50, 1, ()),
}


def posts(spark, cases):
    return spark.createDataFrame(cases, POST).withColumn("arrived", F.timestamp_millis(F.col("ms") + START)).withColumn("key", F.lit("own")).drop("ms")


def told(rows):
    return {(r["key"], r["opened_ms"] - START, r["n_posts"], tuple(r["parts"])) for r in rows}


def test_posts_of_a_table_are_merged(spark):
    found = debounce.merge_table(posts(spark, CASES)).collect()
    assert told(found) == WANTED and len(found) == len(WANTED)
    assert debounce.merge_table(posts(spark, []).limit(0)).count() == 0


def test_posts_of_a_stream_are_merged(spark, tmp_path):
    later = [post(99, 60_000, sender="z", parts=["end"])]
    found = streamed(spark, tmp_path, posts(spark, CASES + later).coalesce(1), debounce.merge_stream)
    assert told(found) == WANTED and len(found) == len(WANTED)


def test_files_links_and_parts(spark):
    cases = [("get a b.APK, then x.docx", ["x", "y"]), (".apk", None), (None, None), ("(a.js.apk.pdf", [])]
    rows = spark.createDataFrame(cases, "text string, parts array<string>")
    assert [r[0] for r in rows.select(X.file_names(F.col("text"))).collect()] == [
        ["get a b.APK", "then x.doc", "then x.docx"], [], [], ["(a.js.apk", "(a.js", "(a.js.apk.pdf"],
    ]
    rows = spark.createDataFrame([(["see  www.a.b/c, or", "bit.ly/x", " "], "my file.apk"), ([None, "see  www.a.b/c, or"], None)], "parts array<string>, f string")
    clean = X.norm_parts(F.col("parts"))
    got = rows.select(clean, X.chat_links(clean), X.chat_file(F.array("f")), X.chat_file_kind(F.col("f"))).collect()
    assert got[0][0] == ["see www.a.b/c, or", "bit.ly/x"] and got[0][1] == ["www.a.b/c", "bit.ly/x"]
    assert tuple(got[0][2:]) == ("my file.apk", "APK dastur fayli") and tuple(got[1][2:]) == (None, None)


def test_burst_and_sender(spark):
    rows = spark.createDataFrame([([("a", 0), ("b", 600), (" ", 9000), ("c", 2000)], "Ann")], "posts array<struct<text string, ms long>>, sender string")
    assert [p["text"] for p in rows.select(X.latest_burst(F.col("posts"))).first()[0]] == ["b", "c"]
    rows = spark.createDataFrame([("Ann: hi", "Ann"), ("Ann - 📎 x", "Ann"), ("Bob: hi", "Ann"), ("Файл f", None)], "text string, sender string")
    assert [r[0] for r in rows.select(X.without_sender(F.col("text"), F.col("sender"))).collect()] == ["hi", "x", "Bob: hi", "f"]


def test_result_texts(spark):
    kind = "keys array<string>, level string, intent string, tokens array<string>, file string"
    cases = [
        (["prize_bait", "suspicious_link", "otp_request"], "XAVFLI", "REQUEST", ["kod", "pul", "x"], "a.apk"),
        ([], "SHUBHALI", None, [], None),
        (["fear_threat"], "XAVFSIZ", None, [], None),
    ]
    rows = spark.createDataFrame(cases, kind)
    told_ = rows.select(
        X.all_reasons(F.col("keys"), F.col("level"), F.col("tokens"), F.col("file")),
        X.advice(F.col("keys"), F.col("intent"), F.col("file").isNotNull(), F.lit(False)),
    ).collect()
    assert told_[0][0] == [
        "Xabar shubhali havola yordamida shaxsiy akkauntingizni egallashga yoki hisobni tasdiqlashga va shubhali havolaga o'tishga urinmoqda.",
        X.WARNINGS["XAVFLI"], "Shubhali so'zlar: kod, pul", "Fayl nomi: a.apk",
    ]
    assert told_[0][1] == [*X.ADVICE_FILE, X.ADVICE_LINK[0]]
    assert (told_[1][0], told_[1][1]) == ([X.VAGUE_REASON], [X.ADVICE_NONE])
    assert told_[2][0] == [X.SAFE_REASON]


def test_added_signals(spark):
    row = spark.createDataFrame([(["a"], ["http://x.xyz/login"], ["f.apk"])], "s array<string>, l array<string>, f array<string>")
    got = row.select(X.added_signals(F.col("s"), F.col("l"), F.lit(True), F.lit(False), F.col("f"))).first()[0]
    assert got == ["a", "suspicious_link", "suspicious_tld_match", "phishing_login", "dangerous_file_extension"]
